"""Rank correlations on bootstrap replicates, with no replicate in one task.

A cluster's multiplicities in all replicates are one packed vector, and vectors move, not
drawn rows.  Rows are dealt once into ranges of (group, value).  A range's rows know their
weighted ranks in every replicate from the weights before them in the range and from a
table of what lies outside it: the weights of its first group in earlier ranges, and of
the ties of its first and last value in others.  That table has four vectors a range.

Ranks are doubled, so they are whole numbers.  Three ways lead to the same numbers:

- Groups of at most ``GROUP_ROWS`` rows are ranked whole, each in the task that has its rows.
- A pooled target of at most ``VALUES`` distinct values has its ranks in a table (value,
  replicate); rows go into the ranges of each model with their value's number only.
- All else: the target's ranks are found by ranges too and go with the rows into the ranges
  of each model, where products are summed by group.

Rows are taken in blocks: a matrix (row, replicate) at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .order import numbered, ranged
from .resample import md5_heads

#: Bytes that the table of the ranges' outsides may have; more replicates are done in turns.
EDGE_BYTES = 64 << 20
SUMS = 10
#: Rows of a group that one task ranks, distinct values of a target whose ranks are a table, rows and replicates of a block.
GROUP_ROWS, VALUES, BLOCK, BLOCK_REPS = 20_000, 4_096, 64, 64
#: Draws that a task makes at once; a draw's replicate has 16 bits.
DRAWS, MOST_REPS = 4_000_000, 1 << 16


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, as many as the largest needs (the first byte)."""
    width = next(k for k in (1, 2, 4, 8) if k == 8 or not len(values) or int(values.max()) < 1 << 8 * k)
    planes = np.ascontiguousarray(values, f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _narrow(data: bytes, reader: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(reader.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    if data[0] == 1:
        return planes[0]
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").reshape(-1)


def unpack(data: bytes) -> np.ndarray:
    return _narrow(data, zstandard.ZstdDecompressor()).astype(np.int64)


def unpacked(column: list[bytes], reps: int) -> np.ndarray:
    """(rows, replicates) of packed vectors, as narrow as they are."""
    reader = zstandard.ZstdDecompressor()
    return np.stack([_narrow(w, reader) for w in column]) if column else np.zeros((0, reps), np.uint8)


def _picks(seed: int, first: int, reps: int, numbers: np.ndarray, n: int) -> np.ndarray:
    """(replicates, numbers): the cluster that each draws; the numbers are texts of one length."""
    prefixes, out = [f"boot|{seed}|{first + rep}|".encode() for rep in range(reps)], []
    at = 0
    while at < reps:
        some = prefixes[at : at + max(1, (1 << 16) // len(numbers))]
        some = some[: next((k for k, p in enumerate(some) if len(p) != len(some[0])), len(some))]
        texts = np.empty((len(some), len(numbers), len(some[0]) + numbers.dtype.itemsize), np.uint8)
        texts[:, :, : len(some[0])] = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), 1, -1)
        texts[:, :, len(some[0]) :] = numbers.view(np.uint8).reshape(1, len(numbers), -1)
        flat = texts.reshape(-1, texts.shape[2]).view(f"S{texts.shape[2]}").reshape(-1)
        heads = [md5_heads(np.ascontiguousarray(flat[k : k + 4096])) for k in range(0, len(flat), 4096)]
        out.append((np.concatenate(heads).astype(np.int64) % n).reshape(len(some), -1))
        at += len(some)
    return np.concatenate(out)


def packed_draws(df: DataFrame, cluster: str, first: int, reps: int, seed: int) -> DataFrame:
    """(cluster, w): how often each of the replicates from ``first`` on draws the cluster; as many draws as clusters.

    A task makes all draws of a run of numbers, as arrays, and sends them to the blocks of
    clusters that they draw; no row a draw is made.
    """
    spark = df.sparkSession
    own = checkpointed(numbered(df.select(cluster).distinct(), [cluster]), "clusters")
    n = own.count()
    size = max(1, min(1 << 16, DRAWS // reps, max(256, n // (2 * spark.sparkContext.defaultParallelism))))
    runs = -(-n // size)

    def drawn(batches):
        for batch in batches:
            for run in batch.column(0).to_pylist():
                i = np.arange(run * size, min(n, (run + 1) * size))
                digits = np.char.str_len(i.astype("S"))
                parts = [i[digits == k].astype(f"S{k}") for k in np.unique(digits)]
                to = np.concatenate([_picks(seed, first, reps, p, n) for p in parts], axis=1)
                block, entry = to // size, ((to % size) << 16) | np.arange(reps)[:, None]
                order = np.argsort(block, axis=None, kind="stable")
                block, entry = block.reshape(-1)[order], entry.reshape(-1)[order].astype("<u4")
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([e.tobytes() for e in np.split(entry, cuts[1:])], pa.binary())], names=["block", "draws"])

    def counted(batches):
        """A block's clusters; about as many draws as its clusters have in all replicates."""
        now, held = None, []

        def close():
            entry = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            counts = np.bincount((entry >> 16) * reps + (entry & 0xFFFF), minlength=size * reps).reshape(size, reps)
            some = np.flatnonzero(counts.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(some + now * size), pa.array([pack(counts[k]) for k in some], pa.binary())], names=["_i", "w"])

        for batch in batches:
            for block, draws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and block != now:
                    yield close()
                    held = []
                now = block
                held.append(draws)
        if held:
            yield close()

    sent = spark.range(0, runs, 1, max(1, runs)).mapInArrow(drawn, "block long, draws binary")
    met = sent.repartition(max(1, runs), "block").sortWithinPartitions("block").mapInArrow(counted, "_i long, w binary")
    return met.join(own.hint("merge"), "_i").select(cluster, "w")


def _sorted_ranges(rows: DataFrame) -> DataFrame:
    return rows.repartition("_part").sortWithinPartitions("_part", "g", "v")


def _outsides(rows: DataFrame, reps: int) -> dict[int, tuple]:
    """For each range: what its first group and its first and last ties weigh elsewhere, and whether its first and last groups go on there."""
    key = F.struct("g", "v")
    ends = rows.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    flagged = rows.select("_part", "w", "g", "v").join(F.broadcast(ends), "_part")
    last = flagged.select("_part", "w", (F.col("g") == F.col("hi.g")).alias("group"), ((F.col("g") == F.col("lo.g")) & (F.col("v") == F.col("lo.v"))).alias("low"), ((F.col("g") == F.col("hi.g")) & (F.col("v") == F.col("hi.v"))).alias("high"))

    def summed(batches):
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                parts, w = block.column(0).to_numpy(zero_copy_only=False), unpacked(block.column(1).to_pylist(), reps)
                flags = [block.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3, 4)]
                for part in np.unique(parts).tolist():
                    own = sums.setdefault(part, np.zeros((3, reps), np.int64))
                    for k, flag in enumerate(flags):
                        own[k] += w[(parts == part) & flag].sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(s.reshape(-1)) for s in sums.values()], pa.binary())], names=["_part", "s"])

    # At most a few rows a range; the table's size is checked by the caller.
    found: dict[int, np.ndarray] = {}
    for r in last.where("group or low or high").mapInArrow(summed, "_part int, s binary").collect():
        found[r["_part"]] = found.get(r["_part"], 0) + unpack(r["s"]).reshape(3, reps)
    keys = {r["_part"]: (tuple(r["lo"]), tuple(r["hi"])) for r in ends.collect()}
    order, none, out = sorted(keys), np.zeros(reps, np.int64), {}
    start, before = none, none
    for at, p in enumerate(order):
        (lo, hi), prior = keys[p], keys[order[at - 1]] if at else None
        if prior is not None:
            q = order[at - 1]
            start = found[q][0] + (start if prior[0][0] == prior[1][0] else 0) if prior[1][0] == lo[0] else none
            before = found[q][2] + (before if prior[0] == prior[1] else 0) if prior[1] == lo else none
        out[p] = [start, before, none, prior is not None and prior[1][0] == lo[0], False, lo, hi]
    after = none
    for at in range(len(order) - 2, -1, -1):
        p, q = order[at], order[at + 1]
        after = found[q][1] + (after if keys[q][0] == keys[q][1] else 0) if keys[q][0] == keys[p][1] else none
        out[p][2], out[p][4] = after, keys[q][0][0] == keys[p][1][0]
    return {p: tuple(v) for p, v in out.items()}


def _ties(batches, columns: int, outsides, reps: int):
    """Of rows sorted by range, group and value: (range, group, rows of a tie, doubled ranks by replicate)."""
    table = outsides.value
    part, group, value, held = None, None, None, []
    local = np.zeros(reps, np.int64)

    def tie():
        nonlocal local
        start, before, after, _, _, lo, hi = table[part]
        own = sum((h[0] for h in held), np.zeros(reps, np.int64))
        total, ahead = own, local + start if group == lo[0] else local
        if (group, value) == lo:
            total, ahead = total + before, ahead - before
        if (group, value) == hi:
            total = total + after
        local = local + own
        return part, group, held, 2 * ahead + total + 1

    for batch in batches:
        for p, g, v, w, *rest in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
            if held and (p, g, v) != (part, group, value):
                yield tie()
                held = []
            if (p, g) != (part, group):
                local = np.zeros(reps, np.int64)
            part, group, value = p, g, v
            held.append((unpack(w), w, *rest))
    if held:
        yield tie()


def _rho(s: np.ndarray, least: int) -> np.ndarray:
    """Correlations from the ten sums of each replicate; nan below ``least`` drawn rows or where a side is constant."""
    n, x, y, xx, yy, xy, x_low, x_high, y_low, y_high = s
    m = np.maximum(n, 1)
    scale = (xx - x * x / m) * (yy - y * y / m)
    good = (n >= least) & (x_low < x_high) & (y_low < y_high) & (scale > 0)
    return np.where(good, (xy - x * y / m) / np.sqrt(np.where(good, scale, 1)), np.nan)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.vstack([a[:6] + b[:6], np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9])])


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Rows in ranges of (g, v); equal values may be cut where a range ends."""
    return ranged(rows.withColumn("_t", F.xxhash64(*rows.columns)), ["g", "v", "_t"]).drop("_t")


def weighted_spearman(rows: DataFrame, weights: DataFrame, cluster: str, y: str, models: list[str], reps: int, grp: str | None = None, least: int = 12, values: np.ndarray | None = None) -> DataFrame:
    """(rep, model columns): Spearman of each model on each replicate, pooled or as the mean within groups.

    ``weights``: (cluster, w) as of :func:`packed_draws`.  A group counts with ``least`` drawn
    rows (3, pooled); a row that lacks a value takes no part.  ``values``: all distinct values of
    a pooled target, where they are few.
    """
    group = F.coalesce(F.col(grp).cast("string"), F.lit("\0null")) if grp else F.lit("")
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (y, *models)))
    given = rows.where(whole).select(cluster, group.alias("g"), F.col(y).cast("double").alias("v"), *(F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(models)))
    if grp:
        return _within(given, weights, cluster, models, reps, least)
    if values is not None:
        return _pooled(given, weights, cluster, models, reps, values)
    met = given.join(weights.hint("merge"), cluster).select("g", "v", "w", *(f"m{k}" for k in range(len(models))))
    found = [_means(s, reps).withColumnRenamed("rho", m) for s, m in zip(_by_ranges(met, len(models), reps, 3), models, strict=True)]
    return reduce(lambda a, b: a.join(b, "rep", "full"), found)  # a row a replicate


def _by_ranges(rows: DataFrame, models: int, reps: int, least: int) -> list[DataFrame]:
    """(s) of each model: correlations, a row a group, of groups of any size and targets of any values."""
    spark, dealt = rows.sparkSession, _dealt(rows, "target")
    names = [f"m{k}" for k in range(models)]
    table = spark.sparkContext.broadcast(_outsides(dealt, reps))
    fields = ", ".join(f"{n} double" for n in names)
    schema = pa.schema([("g", pa.string()), ("w", pa.binary()), ("ry", pa.binary()), *((n, pa.float64()) for n in names)])

    def target_ranks(batches):
        out = []
        for _, g, held, ranks in _ties(batches, 4 + len(names), table, reps):
            packed = pack(ranks)
            for _, w, *rest in held:
                out.append((g, w, packed, *rest))
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ranked = checkpointed(_sorted_ranges(dealt).select("_part", "g", "v", "w", *names).mapInArrow(target_ranks, f"g string, w binary, ry binary, {fields}"), "target-ranks")
    return [_model(ranked.select("g", F.col(n).alias("v"), "w", "ry"), reps, least) for n in names]


def _model(rows: DataFrame, reps: int, least: int) -> DataFrame:
    """(s): a model's correlations, a row a group."""
    dealt = _dealt(rows, "model")
    table = rows.sparkSession.sparkContext.broadcast(_outsides(dealt, reps))

    def sums(batches):
        """A group's correlations, or its sums where it is cut."""
        now, total = None, None

        def close():
            part, g = now
            *_, from_before, goes_on, lo, hi = table.value[part]
            cut = (from_before and g == lo[0]) or (goes_on and g == hi[0])
            values = total if cut else _rho(total, least)
            return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([cut]), pa.array([values.astype("<f8").tobytes()], pa.binary())], names=["g", "cut", "s"])

        for part, g, held, x in _ties(batches, 5, table, reps):
            if (part, g) != now:
                if now is not None:
                    yield close()
                now, total = (part, g), np.vstack([np.zeros((6, reps)), *[np.full((1, reps), s * np.inf) for s in (1, -1, 1, -1)]])
            x = x.astype(float)
            for w, _, packed in held:
                y, drawn, w = unpack(packed).astype(float), w > 0, w.astype(float)
                wx, wy = w * x, w * y
                total[:6] += [w, wx, wy, wx * x, wy * y, wx * y]
                for k, (v, take, none) in enumerate(((x, np.minimum, np.inf), (x, np.maximum, -np.inf), (y, np.minimum, np.inf), (y, np.maximum, -np.inf))):
                    take(total[6 + k], np.where(drawn, v, none), out=total[6 + k])
        if now is not None:
            yield close()

    def joined(pdf):
        """A cut group's sums, at most one row a range."""
        parts = [np.frombuffer(s, "<f8").reshape(SUMS, reps) for s in pdf["s"]]
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "s": [_rho(reduce(_merged, parts), least).astype("<f8").tobytes()]})

    each = checkpointed(_sorted_ranges(dealt).select("_part", "g", "v", "w", "ry").mapInArrow(sums, "g string, cut boolean, s binary"), "group-sums")
    return each.where("not cut").select("s").unionByName(each.where("cut").groupBy("g").applyInPandas(joined, "g string, s binary").select("s"))


def _means(rho: DataFrame, reps: int) -> DataFrame:
    """(rep, rho) from groups' correlations ``s``: their mean, without those that are undefined."""

    def means(batches):
        total, n = np.zeros(reps), np.zeros(reps, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                rho = np.frombuffer(s, "<f8")
                total, n = total + np.nan_to_num(rho), n + ~np.isnan(rho)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["total", "n"])

    partial = rho.mapInArrow(means, "total array<double>, n array<bigint>")
    cells = partial.select(F.posexplode(F.arrays_zip("total", "n")).alias("rep", "x")).select("rep", "x.*")
    return cells.groupBy("rep").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("rho"))


def _tied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the values, and where in it each distinct value begins."""
    order = np.argsort(values, kind="stable")
    return order, np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])


def _doubled(w: np.ndarray) -> np.ndarray:
    """Doubled ranks of ties in order, from what each weighs by replicate."""
    return 2 * np.cumsum(w, axis=0) - w + 1


def group_rho(y: np.ndarray, models: list[np.ndarray], w: np.ndarray, least: int) -> np.ndarray:
    """(models, replicates): Spearman of each model in one group; ``w``: (rows, replicates)."""
    out = np.empty((len(models), w.shape[1]))
    (y_order, y_cuts), ties = _tied(y), [_tied(m) for m in models]
    place = np.empty(len(y), np.int64)
    place[y_order] = np.repeat(np.arange(len(y_cuts)), np.diff(np.r_[y_cuts, len(y)]))
    for at in range(0, w.shape[1], BLOCK_REPS):
        own = w[:, at : at + BLOCK_REPS].astype(float)
        weight_y = np.add.reduceat(own[y_order], y_cuts, axis=0)
        ry = _doubled(weight_y)
        y_sums = _side(weight_y, ry)
        products = own * ry[place]
        for k, (order, cuts) in enumerate(ties):
            weight_x, cross = (own[order], products[order]) if len(cuts) == len(order) else (np.add.reduceat(a[order], cuts, axis=0) for a in (own, products))
            rx = _doubled(weight_x)
            x_sums = _side(weight_x, rx)
            out[k, at : at + BLOCK_REPS] = _rho(_ten(x_sums, y_sums, np.einsum("ij,ij->j", cross, rx)), least)
    return out


def _first(w: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Each replicate's rank at its first drawn tie; infinite without one.  Nearly always one of the first few."""
    out = np.full(w.shape[1], np.inf)
    for k in range(len(w)):
        lacks = np.flatnonzero(np.isinf(out))
        if not len(lacks):
            break
        out[lacks] = np.where(w[k, lacks] > 0, ranks[k, lacks], np.inf)
    return out


def _side(w: np.ndarray, ranks: np.ndarray) -> tuple:
    """n, sum, sum of squares, lowest and highest of one side's ranks, from its ties in order."""
    wr = w * ranks
    return w.sum(axis=0), wr.sum(axis=0), np.einsum("ij,ij->j", wr, ranks), _first(w, ranks), -_first(w[::-1], -ranks[::-1])


def _ten(x: tuple, y: tuple, cross: np.ndarray) -> np.ndarray:
    return np.stack([x[0], x[1], y[1], x[2], y[2], cross, x[3], x[4], y[3], y[4]])


def _small_groups(rows: DataFrame, models: int, reps: int, least: int) -> DataFrame:
    """(model, s): correlations of groups that a task ranks whole; ``rows``: (g, v, w, m0, ...)."""
    names = [f"m{k}" for k in range(models)]

    def ranked(batches):
        now, held = None, []

        def close():
            v, w, *m = ([x for h in held for x in h[k]] for k in range(2 + models))
            found = group_rho(np.array(v, float), [np.array(c, float) for c in m], unpacked(w, reps), least)
            return pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in found], pa.binary())], names=["model", "s"])

        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and g[a] != now:
                    yield close()
                    held = []
                now = g[a]
                held.append([batch.column(k).slice(a, b - a).to_pylist() for k in range(1, 3 + models)])
        if held:
            yield close()

    return rows.repartition("g").sortWithinPartitions("g").select("g", "v", "w", *names).mapInArrow(ranked, "model int, s binary")


def _within(given: DataFrame, weights: DataFrame, cluster: str, models: list[str], reps: int, least: int) -> DataFrame:
    sizes = given.groupBy("g").agg(F.count("*").alias("_rows"))
    large = checkpointed(sizes.where(F.col("_rows") > GROUP_ROWS).select("g"), "large-groups")
    names = [f"m{k}" for k in range(len(models))]
    all_small = large.isEmpty()
    met = lambda rows: rows.join(weights.hint("merge"), cluster).select("g", "v", "w", *names)
    small = given if all_small else given.join(F.broadcast(large), "g", "left_anti")
    found = checkpointed(_small_groups(met(small), len(models), reps, least), "group-rho")
    rest = None if all_small else _by_ranges(met(given.join(F.broadcast(large), "g", "left_semi")), len(models), reps, least)
    out = []
    for k, m in enumerate(models):
        own = found.where(F.col("model") == k).select("s")
        out.append(_means(own if rest is None else own.unionByName(rest[k]), reps).withColumnRenamed("rho", m))
    return reduce(lambda a, b: a.join(b, "rep", "full"), out)


def _pooled(given: DataFrame, weights: DataFrame, cluster: str, models: list[str], reps: int, values: np.ndarray) -> DataFrame:
    """(rep, model columns) where the target has few distinct ``values`` (sorted)."""
    spark, names = given.sparkSession, [f"m{k}" for k in range(len(models))]
    known = spark.sparkContext.broadcast(values)

    def coded(batches):
        for batch in batches:
            code = np.searchsorted(known.value, batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns[1:]], names=["code", "w", *names])

    fields = ", ".join(f"{n} double" for n in names)
    met = given.join(weights.hint("merge"), cluster).select("v", "w", *names)
    rows = checkpointed(met.mapInArrow(coded, f"code int, w binary, {fields}"), "weighted")

    def by_value(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                code = block.column(0).to_numpy(zero_copy_only=False)
                order, cuts = _tied(code)
                each = np.add.reduceat(unpacked(block.column(1).to_pylist(), reps)[order], cuts, axis=0, dtype=np.int64)
                for c, w in zip(code[order][cuts].tolist(), each, strict=True):
                    sums[c] = sums[c] + w if c in sums else w
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(w) for w in sums.values()], pa.binary())], names=["code", "w"])

    weight = np.zeros((len(values), reps))
    for r in rows.select("code", "w").mapInArrow(by_value, "code int, w binary").repartition("code").mapInArrow(by_value, "code int, w binary").collect():
        weight[r["code"]] = unpack(bytes(r["w"]))  # a row a value
    ranks = _doubled(weight)
    y_sums, table = _side(weight, ranks), spark.sparkContext.broadcast(ranks)

    def one(name):
        dealt = _dealt(rows.select(F.lit("").alias("g"), F.col(name).alias("v"), "w", "code"), "model")
        outsides = spark.sparkContext.broadcast(_outsides(dealt, reps))

        def sums(batches):
            """The sums of each range of rows, which come sorted by range and value."""
            part, local, total, tie = None, None, None, None

            def close(value, w, cross):
                """Ties in order, that no later row belongs to."""
                nonlocal local, total
                start, before, after, _, _, lo, hi = outsides.value[part]
                ahead, weight = local + start + np.cumsum(w, axis=0) - w, w.copy()
                if value[0] == lo[1]:
                    ahead[0] -= before
                    weight[0] += before
                if value[-1] == hi[1]:
                    weight[-1] += after
                local = local + w.sum(axis=0)
                x = _side(w, 2 * ahead + weight + 1)
                none = np.zeros(reps), np.zeros(reps), np.zeros(reps), np.full(reps, np.inf), np.full(reps, -np.inf)
                ten = _ten(x, none, np.einsum("ij,ij->j", cross, 2 * ahead + weight + 1))
                total = ten if total is None else _merged(total, ten)

            def done():
                close(*tie)
                return pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["s"])

            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    block = batch.slice(at, BLOCK)
                    parts = block.column(0).to_numpy(zero_copy_only=False)
                    for own in np.unique(parts).tolist():
                        pick = np.flatnonzero(parts == own)
                        mine = block.slice(int(pick[0]), len(pick))
                        if own != part:
                            if part is not None:
                                yield done()
                            part, local, total, tie = own, np.zeros(reps), None, None
                        value = mine.column(1).to_numpy(zero_copy_only=False)
                        w = unpacked(mine.column(2).to_pylist(), reps).astype(float)
                        cross = w * table.value[mine.column(3).to_numpy(zero_copy_only=False)]
                        cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
                        if len(cuts) < len(value):
                            value, w, cross = value[cuts], np.add.reduceat(w, cuts, axis=0), np.add.reduceat(cross, cuts, axis=0)
                        if tie is not None and tie[0][0] == value[0]:
                            w[0] += tie[1][0]
                            cross[0] += tie[2][0]
                        elif tie is not None:
                            close(*tie)
                        if len(value) > 1:
                            close(value[:-1], w[:-1], cross[:-1])
                        tie = value[-1:], w[-1:].copy(), cross[-1:].copy()
            if part is not None:
                yield done()

        def joined(batches):
            """At most one row a range."""
            total = None
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    own = np.frombuffer(s, "<f8").reshape(SUMS, reps)
                    total = own if total is None else _merged(total, own)
            if total is not None:
                total = total.copy()
                total[2], total[4], total[8], total[9] = y_sums[1:]
                yield pa.RecordBatch.from_arrays([pa.array([_rho(total, 3).astype("<f8").tobytes()], pa.binary())], names=["s"])

        each = _sorted_ranges(dealt).select("_part", "v", "w", "code").mapInArrow(sums, "s binary")
        return _means(checkpointed(each, "range-sums").coalesce(1).mapInArrow(joined, "s binary"), reps)

    found = [one(n).withColumnRenamed("rho", m) for n, m in zip(names, models, strict=True)]
    return reduce(lambda a, b: a.join(b, "rep", "full"), found)  # a row a replicate


def bootstrap_spearman(rows: DataFrame, cluster: str, y: str, models: list[str], reps: int, seed: int, grp: str | None = None, least: int = 12) -> DataFrame:
    """(rep, model columns): :func:`weighted_spearman` on ``reps`` hashed cluster draws, all models on the same draws."""
    spark = rows.sparkSession
    rows = checkpointed(rows.select(cluster, y, *models, *([grp] if grp else [])), "scored")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = [] if grp else rows.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("v")).distinct().limit(VALUES + 1).collect()
    values = np.sort(np.array([r["v"] for r in seen], float)) if 0 < len(seen) <= VALUES else None
    turn = max(1, min(reps, MOST_REPS, EDGE_BYTES // (8 * max(4 * ranges, 0 if values is None else len(values)))))
    out = []
    for first in range(0, reps, turn):
        n = min(turn, reps - first)
        one = weighted_spearman(rows, packed_draws(rows, cluster, first, n, seed), cluster, y, models, n, grp, least, values)
        out.append(one.withColumn("rep", F.col("rep") + first))
    return reduce(DataFrame.unionByName, out)
