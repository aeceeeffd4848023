"""Fits on one-hot groups and letters of a text, by Newton's steps from few passes.

A row has one group at most and one letter a place, so the groups' part of the second
derivatives is a diagonal: it is eliminated group by group, in Spark, and the driver
solves for the constant and the letters alone.  The groups' weights are a table; nothing
of their number is sent to the driver or held by a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: A step that lowers the mean loss by less is the last; what it leaves is of the order of the square.
_SETTLED = 1e-9
#: The character that stands for no letter; the letters' follow it.
_ZERO = ord("@")


@dataclass
class Fit:
    """Weights: of the constant, of the letters (places by letters) and of the groups (a table of the group and ``b``, or None)."""

    constant: float
    letters: np.ndarray
    groups: DataFrame | None


def letters_of(text: str, alphabet: str, length: int) -> Column:
    """A character a place: the letter's number in the alphabet, from 1, after ``@``; 0 for any other letter."""
    if len(alphabet) > 60:
        raise ValueError("the alphabet has more than 60 letters")
    each = [F.substring(text, p, 1) for p in range(1, length + 1)]
    return F.concat(*(F.char(F.lit(_ZERO) + F.coalesce(F.when(F.length(c) == 1, F.instr(F.lit(alphabet), c)), F.lit(0))) for c in each))


def by_group(df: DataFrame, grp: str) -> DataFrame:
    """``df``, which is read twice, written in the order of its groups, so that a batch of a pass has few; a group of any size is cut."""
    return checkpointed(df.repartitionByRange(F.col(grp), F.xxhash64(*df.columns)).sortWithinPartitions(grp), "by_group")


def _pass(batches, logistic: bool, constant: float, letters: np.ndarray):
    """Sums of each batch's groups, and once of all rows: residuals, curvatures and products of the letters."""
    places, width = letters.shape
    table = np.column_stack([np.zeros(places), letters])
    k, size = width + 1, 1 + places * width
    whole = np.zeros(2)
    cells_sum, curved, products = np.zeros((3, places, k)), np.zeros(2), np.zeros((places, places, k * k))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = np.frombuffer(batch.column(1).buffers()[2], np.uint8, n * places, batch.column(1).offset * places)
        cell = np.ascontiguousarray(codes.reshape(n, places).T).astype(np.intp) - _ZERO
        y = batch.column(2).to_numpy(zero_copy_only=False)
        eta = constant + batch.column(3).to_numpy(zero_copy_only=False)
        for p in range(places):
            eta += table[p].take(cell[p])
        if logistic:
            chance = 1 / (1 + np.exp(-eta))
            off, curve = chance - y, chance * (1 - chance)
            loss = np.logaddexp(0, eta) - y * eta
        else:
            off, curve = eta - y, np.ones(n)
            loss = off * off / 2
        whole += n, loss.sum()
        curved += off.sum(), curve.sum()
        named = batch.column(0).dictionary_encode()
        known = len(named.dictionary)
        # Rows without a group count as the last one, which is not sent on.
        own = named.indices.fill_null(known).to_numpy().astype(np.intp)
        sums = np.zeros((known + 1, 2 + size))
        sums[:, 0], sums[:, 1], sums[:, 2] = (np.bincount(own, w, known + 1) for w in (None, off, curve))
        for p in range(places):
            cells_sum[0, p] += np.bincount(cell[p], None, k)
            cells_sum[1, p] += np.bincount(cell[p], off, k)
            cells_sum[2, p] += np.bincount(cell[p], curve, k)
            sums[:, 3 + p * width : 3 + (p + 1) * width] = np.bincount(own * k + cell[p], curve, (known + 1) * k).reshape(-1, k)[:, 1:]
            row = cell[p] * k
            for q in range(p):
                products[p, q] += np.bincount(row + cell[q], curve, k * k)
        if known:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(known + 1) * (2 + size), pa.int32()), pa.array(sums[:known].ravel()))
            yield pa.RecordBatch.from_arrays([named.dictionary, lists, pa.nulls(known, pa.binary())], names=["grp", "v", "s"])
    second = np.zeros((size, size))
    block = second[1:, 1:].reshape(places, width, places, width)
    for p in range(places):
        block[p, :, p, :] = np.diag(cells_sum[2, p, 1:])
        for q in range(p):
            block[p, :, q, :] = products[p, q].reshape(k, k)[1:, 1:]
            block[q, :, p, :] = block[p, :, q, :].T
    second[0, 0] = curved[1]
    second[0, 1:] = second[1:, 0] = cells_sum[2, :, 1:].ravel()
    first = np.append(curved[0], cells_sum[1, :, 1:])
    total = np.concatenate([whole, cells_sum[0, :, 1:].ravel(), first, second.ravel()])
    yield _bytes(total, "grp", "v")


def _bytes(total: np.ndarray, *before: str) -> pa.RecordBatch:
    types = {"grp": pa.string(), "v": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, types[c]) for c in before), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=[*before, "s"])


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors in column s, one a task, added in two levels."""

    def summed(batches):
        total = None
        for batch in batches:
            for s in batch.column(0).to_pylist():
                own = np.frombuffer(s, "<f8")
                total = own if total is None else total + own
        if total is not None:
            yield _bytes(total)

    few = max(1, math.isqrt(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    level = parts.select("s").repartition(few).mapInArrow(summed, "s binary")
    return np.sum([np.frombuffer(bytes(r["s"]), "<f8") for r in level.collect()], axis=0)


def _eliminated(batches, size: int):
    """What the groups take from the second and first derivatives of the rest, and the square of their own steps."""
    second, first, square = np.zeros((size, size)), np.zeros(size), 0.0
    for batch in batches:
        v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        pull, slope = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        own = pull > 0
        cross, slope = v[own, 2:], slope[own]
        stiff = cross[:, 0] + pull[own]
        second += cross.T @ (cross / stiff[:, None])
        first += cross.T @ (slope / stiff)
        square += slope @ (slope / stiff)
    yield _bytes(np.concatenate([[square], first, second.ravel()]))


def _moved(batches, step: np.ndarray):
    """Each group's weight and the step that follows from the others'."""
    for batch in batches:
        v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        pull, slope = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        move = np.where(pull > 0, -(slope + v[:, 2:] @ step) / (v[:, 2] + pull + (pull <= 0)), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(move), batch.column(1)], names=["grp", "b", "move", "pull"])


def fit(rows: DataFrame, grp: str, letters: str, y: str, width: int, places: int, penalty: float, logistic: bool, most: int = 50) -> Fit:
    """The smallest mean loss plus ``penalty`` / 2 on the squared weights of features of unit deviation, constant aside.

    ``letters``: as of :func:`letters_of`.  ``logistic``: y is 0 or 1; else least squares, with the penalty and loss on y of
    unit deviation.  These are the optima that ML's LogisticRegression and LinearRegression go
    towards; a feature that doesn't vary has weight 0.
    """
    rows = rows.select(F.col(grp).alias("grp"), F.col(letters).alias("cells"), F.col(y).cast("double").alias("y")).where("y is not null")
    n, mean, low, high, deviation = rows.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), F.stddev_pop("y")).first()
    size = 1 + places * width
    if not n:
        raise ValueError("no rows to fit")
    if low == high:
        return Fit((math.inf if mean > 0.5 else -math.inf) if logistic else mean, np.zeros((places, width)), None)
    # Deviations of features are ML's: of a sample for the classifier, of all for least squares.
    force = penalty * n / max(n - 1, 1) if logistic else penalty / deviation
    at, move, step, points, best = np.zeros(size), np.zeros(size), 1.0, None, math.inf
    at[0] = math.log(mean / (1 - mean)) if logistic else mean
    for _ in range(most):
        now = at + step * move
        if points is None:
            joined = rows.withColumn("b", F.lit(0.0))
        else:
            placed = points.select("grp", "pull", (F.col("b") + step * F.col("move")).alias("b"))
            joined = rows.join(placed.select("grp", "b"), "grp", "left").select("grp", "cells", "y", F.coalesce("b", F.lit(0.0)).alias("b"))
        constant, weights = float(now[0]), now[1:].reshape(places, width)
        sums = checkpointed(joined.mapInArrow(lambda it: _pass(it, logistic, constant, weights), "grp string, v array<double>, s binary"), "sums")  # noqa: B023
        total = _added(sums.where("s is not null"))
        loss, counts, first, second = total[1], total[2 : 1 + size], total[1 + size : 1 + 2 * size], total[1 + 2 * size :].reshape(size, size)
        pull = np.append(0.0, force * counts * (1 - counts / n))
        loss += pull @ (now * now) / 2 + (placed.agg(F.sum(F.col("pull") * F.col("b") * F.col("b"))).first()[0] or 0.0) / 2 if points is not None else 0.0
        if loss > best * (1 + 1e-12):
            step /= 2
            continue
        at, best = now, loss
        own = sums.where("v is not null").groupBy("grp").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(2 + size))).alias("v"))
        if points is None:
            own = own.withColumn("b", F.lit(0.0))
        else:
            own = own.join(placed.select("grp", "b"), "grp")
        count = F.col("v")[0]
        own = own.withColumn("pull", F.lit(float(force)) * count * (1 - count / float(n)))
        own = checkpointed(own.select("grp", "pull", "v", (F.col("v")[1] + F.col("pull") * F.col("b")).alias("slope"), "b"), "groups")
        taken = _added(own.mapInArrow(lambda it: _eliminated(it, size), "s binary"))
        first = first + pull * at - taken[1 : 1 + size]
        second = second + np.diag(pull) - taken[1 + size :].reshape(size, size)
        free = np.append(True, pull[1:] > 0)
        move, step = np.zeros(size), 1.0
        move[free] = -np.linalg.solve(second[np.ix_(free, free)], first[free])
        gain = taken[0] - first @ move
        # The copy binds this round's step.
        points = own.mapInArrow(lambda it, move=move.copy(): _moved(it, move), "grp string, b double, move double, pull double")
        if not logistic or gain < _SETTLED * n:
            break
    else:
        raise ValueError(f"no optimum after {most} passes")
    at = at + move
    return Fit(float(at[0]), at[1:].reshape(places, width), points.select(F.col("grp").alias(grp), (F.col("b") + F.col("move")).alias("b")))


def fitted(rows: DataFrame, found: Fit, grp: str, letters: str, out: str) -> DataFrame:
    """``rows`` with the sum of their weights; a group that the fit hasn't seen and any other letter add nothing."""
    own = F.lit(found.constant)
    for p, weights in enumerate(found.letters):
        own = own + F.get(F.array(*(F.lit(float(w)) for w in [0.0, *weights])), F.ascii(F.substring(letters, p + 1, 1)) - _ZERO)
    if found.groups is None:
        return rows.withColumn(out, own)
    joined = rows.join(found.groups.withColumnRenamed("b", "_b"), grp, "left")
    return joined.withColumn(out, own + F.coalesce("_b", F.lit(0.0))).drop("_b")


__all__ = ["Fit", "by_group", "fit", "fitted", "letters_of"]
