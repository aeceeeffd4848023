"""Resampling inference by hashed draws: repeatable on any engine and any layout.

A draw is a hash of (tag, seed, replicate, place), so published intervals of a random
stream are met in distribution, not digit by digit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash32, safe_corr, uniform
from .audits import verdict
from .lineage import checkpointed
from .order import median, numbered, quantiles, running
from .vectors import pair_l1


def draws(df: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(rep, cluster, w): how often each replicate draws a cluster; as many draws as clusters."""
    own = numbered(df.select(cluster).distinct(), [cluster])
    size = own.agg(F.count("*").alias("_n"))
    picks = own.join(F.broadcast(size)).select("_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    chosen = picks.select("rep", (hash32("boot", seed, F.col("rep").cast("string"), F.col("_i").cast("string")) % F.col("_n")).cast("int").alias("_i"))
    counted = chosen.groupBy("rep", "_i").agg(F.count("*").alias("w"))
    return counted.join(own, "_i").select("rep", cluster, "w")


def intervals(values: DataFrame, named: dict[str, Column], reps: int, gate: float = 0.0) -> DataFrame:
    """(metric, mean, lo, hi, n_valid) of each named value: 2.5 and 97.5 percentiles; null if fewer than ``gate`` of the draws are valid."""
    each = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in named.items()))
    rows = checkpointed(values.select(F.explode(each).alias("x")).select("x.*"), "replicates")
    means = rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.count("v").alias("n_valid"))
    both = means.join(quantiles(rows, "v", [0.025, 0.975], ("metric",)), "metric", "left")
    enough = F.col("n_valid") >= F.lit(gate * reps)
    return both.select("metric", *(F.when(enough, c).alias(n) for n, c in (("mean", F.col("mean")), ("lo", F.get("q", 0)), ("hi", F.get("q", 1)))), "n_valid")


def permutation(ids: DataFrame, key: str, reps: int, tag: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(rep, by, key, other): ``other`` runs over the same keys in hashed order; replicate 0 leaves them."""
    rows = ids.select(*by, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    w = Window.partitionBy("rep", *by)
    mixed = F.when(F.col("rep") == 0, F.lit(0)).otherwise(hash32(tag, seed, F.col("rep").cast("string"), F.col(key).cast("string")))
    a = rows.withColumn("_i", F.row_number().over(w.orderBy(key)))
    b = rows.withColumn("_i", F.row_number().over(w.orderBy(mixed, key))).withColumnRenamed(key, "other")
    return a.join(b, ["rep", *by, "_i"]).drop("_i")


def mantel(pairs: DataFrame, reps: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, p, noise): Spearman between two distances of all unordered pairs, permuting the entities of ``g``.

    ``pairs``: (by, a, b, g, t) with a < b.  p counts replicates at least as far from zero,
    the observed one included; ``noise`` is the deviation of the permuted values.
    """
    ids = pairs.select(*by, F.col("a").alias("id")).unionByName(pairs.select(*by, F.col("b").alias("id"))).distinct()
    moved = permutation(ids, "id", reps, "mantel", seed, by)
    left = moved.select("rep", *by, F.col("id").alias("a"), F.col("other").alias("x"))
    right = moved.select("rep", *by, F.col("id").alias("b"), F.col("other").alias("y"))
    g = pairs.select(*by, F.col("a").alias("x"), F.col("b").alias("y"), "g")
    at = pairs.select(*by, "a", "b", "t").join(left, [*by, "a"]).join(right, ["rep", *by, "b"])
    at = at.select("rep", *by, "t", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).join(g, [*by, "x", "y"])
    own = Window.partitionBy("rep", *by)

    def rank(c):
        return F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy("rep", *by, c)) - 1) / F.lit(2.0)

    ranked = at.select("rep", *by, rank("g").alias("rg"), rank("t").alias("rt"))
    rho = ranked.groupBy("rep", *by).agg(safe_corr("rg", "rt").alias("r"))
    seen = F.max(F.when(F.col("rep") == 0, F.col("r")))
    one = rho.select(*by, "r", "rep", seen.over(Window.partitionBy(*by)).alias("r0"))  # one row a replicate
    far = ((F.col("rep") > 0) & (F.abs("r") >= F.abs("r0") - 1e-12)).cast("int")
    out = one.groupBy(*by).agg(F.max("r0").alias("r"), (F.sum(far) + 1).cast("double").alias("n"), F.stddev_pop(F.when(F.col("rep") > 0, F.col("r"))).alias("noise"))
    return out.select(*by, "r", (F.col("n") / (reps + 1)).alias("p"), "noise")


def _ranks(v: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _permuted_r(g: np.ndarray, ts: list[np.ndarray], moves: np.ndarray) -> np.ndarray:
    """Spearman of the upper triangles of each of ``ts`` and of ``g`` under each row of ``moves``, a column each; nan where a side is constant."""
    i, j = np.triu_indices(len(g), 1)
    ranks, own = np.zeros_like(g), np.stack([_ranks(t[i, j]) for t in ts], axis=1)
    ranks[i, j] = ranks[j, i] = _ranks(g[i, j])
    ranks[i, j] -= ranks[i, j].mean()
    ranks[j, i] = ranks[i, j]
    own = own - own.mean(axis=0)
    flat, at = ranks.reshape(-1), moves[:, i] * len(g) + moves[:, j]
    # A permutation moves the same ranks about, so their mean and scale stay.
    scale = np.sqrt((ranks[i, j] ** 2).sum() * (own * own).sum(axis=0))
    return np.where(scale > 0, (flat[at] @ own) / np.where(scale > 0, scale, 1), np.nan)


_MD5_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_ADDS = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of ASCII texts (an array of bytes of at most 55), all taken a step at a time."""
    width = texts.dtype.itemsize
    if width > 55:
        raise ValueError("a text is longer than 55 bytes")
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, :width] = texts.view(np.uint8).reshape(len(texts), width)
    size = np.char.str_len(texts)
    block[np.arange(len(texts)), size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = size * 8
    a, b, c, d = (np.full(len(texts), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for k in range(64):
        if k < 16:
            f, w = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, w = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, w = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, w = c ^ (b | ~d), 7 * k % 16
        f = f + a + words[w] + np.uint32(_MD5_ADDS[k])
        turn = np.uint32(_MD5_TURNS[k])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    return (a + np.uint32(0x67452301)).byteswap()


def _moves(ids: list, reps: int, seed: int) -> np.ndarray:
    """Each replicate's permutation of the ids' places: their order by hash; replicate 0 leaves them."""
    heads = []
    for first in range(1, reps + 1, 1024):  # arrays that stay in the cache
        names = [f"mantel|{seed}|{rep}|".encode() for rep in range(first, min(first + 1024, reps + 1))]
        texts = np.char.add(np.array(names)[:, None], np.array([str(i).encode() for i in ids])[None, :]).reshape(-1)
        heads.append(np.concatenate([md5_heads(np.ascontiguousarray(texts[at : at + 4096])) for at in range(0, len(texts), 4096)]).reshape(len(names), -1))
    mixed = np.argsort(np.concatenate(heads), axis=1, kind="stable") if heads else np.zeros((0, len(ids)), np.int64)
    return np.vstack([np.arange(len(ids)), mixed])


def mantel_parts(df: DataFrame, by: str, key: str, vector: str, cells: int, parts: list[tuple[int, int]], reps: int, seed: int) -> DataFrame:
    """(by, part, r, p, noise) of :func:`mantel` between all ``cells`` of the vectors and each of the ``parts`` (from, to) of them, a structure a group.

    A structure's entities (bounded, as all its pairs are compared) are one small matrix, and
    its replicates are array operations on it: no row a pair and replicate is made.
    Structures with repeated keys or with vectors that lack a cell go through :func:`mantel`.
    """
    rows = df.select(F.col(by).cast("long").alias(by), key, vector).where(F.col(by).isNotNull() & F.col(key).isNotNull())
    good = (F.size(vector) == cells) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    odd = rows.groupBy(by, key).agg(F.count("*").alias("_n"), F.min(F.coalesce(good, F.lit(False))).alias("_good")).where("_n > 1 or not _good").select(by).distinct()

    def test(pdf):
        pdf = pdf.sort_values(key)
        ids, x = pdf[key].tolist(), np.array(pdf[vector].tolist(), float)
        if len(ids) < 2:
            return pd.DataFrame({by: [], "part": [], "r": [], "p": [], "noise": []})
        apart = lambda v: np.abs(v[:, None, :] - v[None, :, :]).mean(axis=2).round(9)
        r = _permuted_r(apart(x), [apart(x[:, a:b]) for a, b in parts], _moves(ids, reps, seed))
        far = (np.abs(r[1:]) >= np.abs(r[0]) - 1e-12).sum(axis=0)
        clean = lambda v: [None if x != x else float(x) for x in v]
        out = pd.DataFrame({by: pdf[by].iloc[0], "part": range(len(parts)), "r": clean(r[0]), "p": (far + 1) / (reps + 1), "noise": clean(np.std(r[1:], axis=0))})
        return out.astype({"r": float, "noise": float})

    schema = f"{by} long, part int, r double, p double, noise double"
    if odd.isEmpty():
        return rows.groupBy(by).applyInPandas(test, schema)
    odd = checkpointed(odd, "odd")
    whole = rows.join(F.broadcast(odd), by, "left_anti").groupBy(by).applyInPandas(test, schema)
    some = checkpointed(rows.join(F.broadcast(odd), by, "left_semi"), "odd-rows")
    g, t = pair_l1(some, key, vector, None, (by,)).select(by, "a", "b", F.round("dist", 9).alias("g")), None
    for part, (a, b) in enumerate(parts):
        one = pair_l1(some, key, vector, F.col("k").between(a, b - 1), (by,)).select(by, "a", "b", F.round("dist", 9).alias("t"), F.lit(part).alias("part"))
        t = one if t is None else t.unionByName(one)
    return whole.unionByName(mantel(g.join(t, [by, "a", "b"]), reps, seed, (by, "part")))


def mantel_blocks(df: DataFrame, by: str, key: str, vector: str, width: int, reps: int, seed: int, cells: int = 64) -> DataFrame:
    """(by, r, p, noise): :func:`mantel_parts` with the first ``width`` cells as the one part."""
    return mantel_parts(df, by, key, vector, cells, [(0, width)], reps, seed).drop("part")


def replicate_metric(rows: DataFrame, picks: DataFrame, cluster: str, y: str, models: list[str], metric) -> DataFrame:
    """(rep, model columns): ``metric(y, model, w)``, an aggregate of weighted rows, on each replicate."""
    drawn = rows.select(cluster, y, *models).join(picks, cluster)
    return drawn.groupBy("rep").agg(*(metric(F.col(y), F.col(m), F.col("w")).alias(m) for m in models))


def replicate_rmse(rows: DataFrame, picks: DataFrame, cluster: str, y: str, models: list[str]) -> DataFrame:
    """(rep, model columns): the root mean squared error of each replicate.

    A cluster's squares are summed once, so what meets the draws is a row a cluster, however many rows it has.
    """
    square = lambda m: (F.col(m) - F.col(y)) * (F.col(m) - F.col(y))
    sums = rows.groupBy(cluster).agg(F.count("*").alias("_n"), *(c for m in models for c in (F.sum(square(m)).alias(f"_s_{m}"), F.count(square(m)).alias(f"_c_{m}"))))
    drawn = checkpointed(sums, "cluster-sums").hint("merge").join(picks, cluster)
    mean = lambda m: F.sum(F.col("w") * F.col(f"_s_{m}")) / F.nullif(F.sum(F.col("w") * F.col(f"_c_{m}")), F.lit(0))
    return drawn.groupBy("rep").agg(*(F.sqrt(mean(m)).alias(m) for m in models))


def weighted_rmse(y: Column, p: Column, w: Column) -> Column:
    return F.sqrt(F.sum(w * (p - y) * (p - y)) / F.sum(w))


def comparison_suite(replicates: DataFrame, pairs: list[tuple[str, str]], reps: int, noise: float, gate: float = 0.0) -> DataFrame:
    """(a, b, mean, lo, hi, n_valid, verdict): the interval of a - b for named pairs of models, all on the same draws."""
    wanted = replicates.sparkSession.createDataFrame([(f"{a}|{b}", a, b) for a, b in pairs], "metric string, a string, b string")
    found = intervals(replicates, {f"{a}|{b}": F.col(a) - F.col(b) for a, b in pairs}, reps, gate)
    out = found.join(F.broadcast(wanted), "metric").select("a", "b", "mean", "lo", "hi", "n_valid")
    return out.withColumn("verdict", verdict(F.col("mean"), F.col("lo"), F.col("hi"), noise))


def overlap_test(chosen: DataFrame, marked: DataFrame, universe: int, reps: int, seed: int, key: str = "position") -> DataFrame:
    """One row: overlap of two sets of positions, what chance expects, and a one-sided p over hashed subsets."""
    spark = chosen.sparkSession
    a, b = chosen.select(key).distinct(), marked.select(key).distinct()
    sizes = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb"))).join(a.join(b, key, "left_semi").agg(F.count("*").alias("overlap")))
    cells = spark.range(universe).select((F.col("id") + 1).cast("int").alias(key)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = Window.partitionBy("rep").orderBy(hash32("subset", seed, F.col("rep").cast("string"), F.col(key).cast("string")), key)
    ranked = cells.withColumn("_r", F.row_number().over(order)).join(F.broadcast(sizes.select("na")), F.col("_r") <= F.col("na"))
    hits = ranked.join(F.broadcast(b.withColumn("_hit", F.lit(1))), key, "left").groupBy("rep").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"))
    out = hits.join(F.broadcast(sizes)).groupBy("overlap", "na", "nb").agg(F.sum((F.col("hits") >= F.col("overlap")).cast("int")).alias("more"))
    return out.select("overlap", (F.col("na") * F.col("nb") / F.lit(float(universe))).alias("expected"), ((F.col("more") + 1) / F.lit(reps + 1.0)).alias("p"))


def shuffled(df: DataFrame, key: list[str], value: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``value`` dealt anew over all rows, or within groups."""
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in key))
    mixed = hash32("shuffle", seed, name)
    if by:
        w = Window.partitionBy(*by)
        a = df.withColumn("_i", F.row_number().over(w.orderBy(*key)))
        b = df.select(*by, F.col(value).alias("_v"), F.row_number().over(w.orderBy(mixed, *key)).alias("_i"))
    else:
        a = numbered(df, key)
        b = numbered(df.select(*key, F.col(value).alias("_v")), [mixed, *key]).select("_v", "_i")
    return a.join(b, [*by, "_i"]).withColumn(value, F.col("_v")).drop("_v", "_i")


def conformal(calibration: DataFrame, test: DataFrame, y: str, p: str, alphas: list[float]) -> DataFrame:
    """Split-conformal intervals: alpha, q, coverage, width and the median width in hours.

    q is the k-th smallest residual, k = ceil((n + 1)(1 - alpha)) and at most n.
    """
    r = checkpointed(calibration.select(F.abs(F.col(y) - F.col(p)).alias("r")), "residuals")
    levels = calibration.sparkSession.createDataFrame([(a,) for a in alphas], "alpha double")
    n = r.agg(F.count("*").alias("n"))
    # (n + 1)(1 - alpha) is rounded first: 0.1 has no exact binary form.
    k = F.least(F.ceil(F.round((F.col("n") + 1) * (1 - F.col("alpha")), 9)), F.col("n"))
    wanted = levels.join(n).select("alpha", k.cast("int").alias("k"))
    ranked = numbered(r, ["r"])
    q = ranked.join(F.broadcast(wanted), F.col("_i") + 1 == F.col("k")).select("alpha", F.col("r").alias("q"))
    q = checkpointed(q, "quantiles")  # a row a level
    rows = checkpointed(test.select(y, p).join(F.broadcast(q)), "tested")
    inside = (F.abs(F.col(y) - F.col(p)) <= F.col("q")).cast("double")
    hours = F.expm1(F.col(p) + F.col("q")) - F.expm1(F.greatest(F.col(p) - F.col("q"), F.lit(0.0)))
    shares = rows.groupBy("alpha", "q").agg(F.avg(inside).alias("coverage"))
    widths = median(rows.select("alpha", hours.alias("h")), "h", "median_width", ("alpha",))
    return shares.join(widths, "alpha").select("alpha", "q", "coverage", (F.col("q") * 2).alias("width"), "median_width")


def hashed_subset(df: DataFrame, key: str, share: float, tag: str, seed: int) -> DataFrame:
    """The first ceil(share) of the distinct keys in hashed order."""
    own = numbered(df.select(key).distinct(), [uniform(tag, seed, F.col(key)), key])
    n = own.agg(F.count("*").alias("_n"))
    return own.join(F.broadcast(n), F.col("_i") < F.ceil(F.col("_n") * share)).select(key)


def quota_take(df: DataFrame, cluster: str, share: float, seed: int) -> DataFrame:
    """(cluster, n): whole clusters in hashed order while the rows before them are under the share."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_t"))
    taken = running(sizes, [uniform("quota", seed, F.col(cluster)), cluster], {"_before": F.col("n")})
    return taken.join(F.broadcast(total), F.col("_before") < F.round(F.col("_t") * share, 6)).select(cluster, "n")
