"""Linear fits from Gram matrices that one pass over the rows adds up.

A matrix has as many rows as there are features, whatever the rows of the data; tasks send
partial ones, which are summed in a tree.  Any subset of the features, scaling and penalty
is then solved, and scored on any part of the rows, without another pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Gram:
    """Products of all pairs of (features, target, 1), shifted by ``origin``, which keeps them exact."""

    products: np.ndarray
    origin: np.ndarray

    @property
    def rows(self) -> float:
        return float(self.products[-1, -1])

    @property
    def mean(self) -> np.ndarray:
        """Of the features and the target, from the origin."""
        return self.products[-1, :-1] / max(self.rows, 1.0)

    @property
    def covariance(self) -> np.ndarray:
        return self.products[:-1, :-1] / max(self.rows, 1.0) - np.outer(self.mean, self.mean)


def grams(df: DataFrame, features: Column, target: Column | None, part: Column) -> dict[str, Gram]:
    """A matrix of each part, by name; rows without a part, features or target take no part.

    ``features`` is an array of one length; without ``target`` zeros stand in its place.
    """
    rows = df.select(features.cast("array<double>").alias("x"), (F.lit(0.0) if target is None else target.cast("double")).alias("y"), part.cast("string").alias("part"))
    rows = rows.where("x is not null and y is not null and part is not null")
    first = rows.first()
    if first is None:
        return {}
    origin = np.array([*first["x"], first["y"]], float)
    if np.isnan(origin).any():
        raise ValueError("a feature is null or not a number")

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), object)
            cells, y = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if (np.diff(cells.offsets.to_numpy()) != len(origin) - 1).any():
                raise ValueError("features differ in length")
            # A batch's arrays are one flat buffer; a null in it becomes not a number.
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([flat.reshape(-1, len(origin) - 1), y]) - origin
            x = np.column_stack([x, np.ones(len(x))])
            for name in set(names):
                own = x[names == name]
                sums[name] = sums.get(name, 0) + own.T @ own
        yield _batch(sums)

    def summed(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(s, "<f8")
        yield _batch(sums)

    schema = "part string, s binary"
    parts = rows.mapInArrow(partial, schema)
    level = parts.repartition(max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(summed, schema)
    out: dict[str, np.ndarray] = {}
    for r in level.collect():
        out[r["part"]] = out.get(r["part"], 0) + np.frombuffer(bytes(r["s"]), "<f8").reshape(len(origin) + 1, -1)
    return {name: Gram(s, origin) for name, s in out.items()}


def _batch(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.asarray(s, "<f8").tobytes() for s in sums.values()], pa.binary())], names=["part", "s"])


def ridge(gram: Gram, columns: list[int], penalty: float, scaled: bool) -> np.ndarray:
    """Weights of some features and, last, of the constant: least squares on a mean, plus ``penalty`` on the weights.

    ``scaled`` puts the penalty on features of unit deviation.  A feature that doesn't vary has weight 0.
    """
    own = np.array(columns, int)
    covariance, mean = gram.covariance, gram.mean
    deviation = np.sqrt(np.maximum(np.diag(covariance)[own], 0))
    varies = deviation > 1e-9
    scale = np.where(varies, deviation, 1.0) if scaled else np.ones(len(own))
    a = covariance[np.ix_(own, own)] / np.outer(scale, scale) + penalty * np.eye(len(own))
    b = covariance[own, -1] / scale
    weights = np.zeros(len(own))
    if varies.any():
        weights[varies] = np.linalg.solve(a[np.ix_(varies, varies)], b[varies]) / scale[varies]
    at = mean + gram.origin
    return np.append(weights, at[-1] - at[own] @ weights)


def rmse(gram: Gram, columns: list[int], weights: np.ndarray) -> float:
    """Root of the mean squared error of a fit on the rows of a matrix."""
    own = np.array(columns, int)
    v = np.zeros(len(gram.origin) + 1)
    v[own], v[-2] = weights[:-1], -1.0
    # The constant, moved to the matrix's origin.
    v[-1] = weights[-1] + gram.origin[own] @ weights[:-1] - gram.origin[-1]
    return float(np.sqrt(max(v @ gram.products @ v, 0.0) / max(gram.rows, 1.0)))


def sweep(df: DataFrame, features: Column, target: Column, split: Column, sets: dict[str, list[int]], penalties: list[float]) -> DataFrame:
    """(features, scaling, penalty, val_rmse, chosen, test_rmse): every set, scaling and penalty fitted on all of ``train``.

    The smallest error on ``val`` is chosen (the first, if equal), and only the chosen one is read on ``test``.
    """
    found, rows = grams(df, features, target, split), []
    if "train" in found:
        for name, columns in sets.items():
            for scaled in (False, True):
                for penalty in penalties:
                    weights = ridge(found["train"], columns, penalty, scaled)
                    rows.append([name, "scaled" if scaled else "plain", float(penalty), rmse(found["val"], columns, weights) if "val" in found else None, False, None, columns, weights])
        known = [r for r in rows if r[3] is not None]
        if known:
            best = min(known, key=lambda r: round(r[3], 12))
            best[4], best[5] = True, rmse(found["test"], best[6], best[7]) if "test" in found else None
    return df.sparkSession.createDataFrame([tuple(r[:6]) for r in rows], "features string, scaling string, penalty double, val_rmse double, chosen boolean, test_rmse double")


@dataclass
class Components:
    """Principal components: the mean, one direction a row, and each one's share of the variance."""

    mean: np.ndarray
    directions: np.ndarray
    retained: np.ndarray


def principal(df: DataFrame, vector: Column, k: int) -> Components | None:
    """The first ``k`` components of all vectors, largest variance first; None for an empty input.

    A direction's largest entry (the first, if equal) is positive.
    """
    found = grams(df, vector, None, F.lit("all"))
    if not found:
        return None
    gram = found["all"]
    values, directions = np.linalg.eigh(gram.covariance[:-1, :-1])
    values, directions = np.maximum(values[::-1], 0)[:k], directions.T[::-1][:k]
    largest = np.abs(np.round(directions, 9)).argmax(axis=1)
    signs = np.sign(directions[np.arange(len(directions)), largest])
    total = np.trace(gram.covariance[:-1, :-1]) or 1.0
    return Components(gram.mean[:-1] + gram.origin[:-1], directions * signs[:, None], values / total)


def projected(df: DataFrame, components: Components, vector: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the array of a vector's coordinates on the components; null for a null vector."""
    weights = df.sparkSession.sparkContext.broadcast((components.mean, components.directions))
    ready = df.withColumn("_x", vector.cast("array<double>"))

    def work(batches):
        mean, directions = weights.value
        for batch in batches:
            x = batch.column(batch.num_columns - 1).to_pylist()
            known = [i for i, v in enumerate(x) if v is not None]
            values: list = [None] * len(x)
            if known:
                for i, row in zip(known, ((np.array([x[i] for i in known], float) - mean) @ directions.T).tolist(), strict=True):
                    values[i] = row
            columns = [*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], out])

    return ready.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
