"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint.  Two fingerprints that differ in at most ``radius``
bits agree in one of ``radius + 1`` bands of bits, so each band's value is a bucket and
no link leaves its buckets.  In a bucket the distinct fingerprints are sorted by
population count and cut into tiles; a tile pair whose counts differ beyond the radius
is skipped, any other is compared exactly by exclusive-or and bit counts.  A bucket over
``bucket_rows`` is itself split by population count and hash into parts, and each pair of
parts within the radius becomes a unit of work of its own, so no task holds it whole.
A unit returns a spanning forest of its links, not all pairs, and components of those
links over the whole corpus give the classes.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
a null doc_id never becomes a component's id unless all ids in it are null; repeated rows
stay separate rows of one class; a very long text is hashed whole; other columns are
ignored; an empty table gives an empty result.

Links at so few bits are those of copies and lightly edited texts; :mod:`.near_copies`
finds near copies by similarity.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import components, spanning

TILE = 1024


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all ``size``-word shingles."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)] or [digest(line, seed)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(batches, names: list[str]):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, fp): fp is the fingerprint as a signed long."""
    source = docs.select(id_col, F.col(text_col).cast("string"))
    schema = T.StructType([source.schema[0], T.StructField("fp", T.LongType())])
    return source.mapInArrow(lambda it: _fingerprints(it, [id_col, "fp"]), schema)


def _forest(near: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Spanning links of a tile pair from its matrix of near pairs."""
    if np.count_nonzero(near) <= 8 * len(near):
        x, y = np.nonzero(near)
        return spanning(x + i, y + j)
    if i == j:
        near = near | near.T
    # Dense: walk over the rows and columns, each visited once.
    rows, columns = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    found = []
    for root in range(near.shape[0]):
        queue = [(root, True)] if rows[root] else []
        rows[root] = False
        while queue:
            at, is_row = queue.pop()
            line, free = (near[at], columns) if is_row else (near[:, at], rows)
            fresh = np.flatnonzero(line & free)
            free[fresh] = False
            own = at + (i if is_row else j)
            found += [(own, n + (j if is_row else i)) for n in fresh.tolist()]
            queue += [(n, not is_row) for n in fresh.tolist()]
    return found


def tile_links(fps: np.ndarray, radius: int, tile: int = TILE, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest over all fingerprints within ``radius``.

    ``fps``: uint64, sorted by population count.
    """
    ones = np.bitwise_count(fps).astype(np.int64)
    left, right = [], []
    for i in range(0, len(fps), tile):
        a = fps[i : i + tile]
        for j in range(i, len(fps), tile):
            if ones[j] - ones[min(i + tile, len(fps)) - 1] > radius:
                break  # counts only grow from here
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius
            near = np.triu(near, 1) if i == j else near
            forest = _forest(near, i, j)
            left += [p for p, _ in forest]
            right += [q for _, q in forest]
    return np.array(left, np.int64), np.array(right, np.int64)


def _compare(batches, radius: int, tile: int):
    """Rows (unit, fp) sorted by unit: one comparison for each unit's run of rows."""
    rest_unit, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(units, fps):
        edges = np.flatnonzero(units[1:] != units[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(units)]])
        out_a, out_b = [], []
        for a, b in zip(*(v[ends - starts > 1].tolist() for v in (starts, ends)), strict=True):
            run = np.unique(fps[a:b])
            if len(run) < 2:
                continue
            if len(run) == 2:
                if (int(run[0]) ^ int(run[1])) & (2**64 - 1) and (int(run[0] ^ run[1]) & (2**64 - 1)).bit_count() <= radius:
                    out_a.append(int(run[0]))
                    out_b.append(int(run[1]))
                continue
            bits = run.view(np.uint64)
            bits = bits[np.argsort(np.bitwise_count(bits), kind="stable")]
            x, y = tile_links(bits, radius, tile)
            signed = bits.view(np.int64)
            out_a += signed[x].tolist()
            out_b += signed[y].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    for batch in batches:
        units = np.concatenate([rest_unit, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(units):
            continue
        cut = int(np.searchsorted(units, units[-1]))  # the last unit may go on
        if cut:
            yield links(units[:cut], fps[:cut])
        rest_unit, rest_fp = units[cut:], fps[cut:]
    if len(rest_unit):
        yield links(rest_unit, rest_fp)


def links(nodes: DataFrame, radius: int = 2, bucket_rows: int = 16_384, tile: int = TILE) -> DataFrame:
    """``nodes``: distinct fp.  Returns links (a, b) that join all fingerprints within ``radius``."""
    bands = radius + 1
    widths = [64 // bands + (i >= bands - 64 % bands) for i in range(bands)]
    shifts = [sum(widths[:i]) for i in range(bands)]
    keys = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("value")) for i, (s, w) in enumerate(zip(shifts, widths, strict=True))]
    rows = nodes.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("k")).select("fp", "ones", "k.band", "k.value")
    classes = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    large = classes.groupBy("band", "value").agg(F.sum("n").alias("rows")).where(F.col("rows") > bucket_rows).select("band", "value")
    # Parts of large buckets: a population count's rows, in as many parts as they need.
    parts = classes.join(large, ["band", "value"]).select("band", "value", "ones", F.ceil(2 * F.col("n") / bucket_rows).cast("int").alias("parts"))
    parts = materialise(parts, "simhash-parts")
    each = parts.select("band", "value", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = each.select("band", "value", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    pairs = each.join(other, ["band", "value"]).where((F.col("ones2") - F.col("ones")).between(0, radius) & ((F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part"))))
    unit = F.xxhash64("band", "value", "ones", "part", "ones2", "part2")
    ends = pairs.select(unit.alias("unit"), "band", "value", F.explode(F.array_distinct(F.array(F.struct("ones", "part"), F.struct(F.col("ones2").alias("ones"), F.col("part2").alias("part"))))).alias("e")).select("unit", "band", "value", "e.ones", "e.part")
    if parts.isEmpty():
        units = rows.select(F.xxhash64("band", "value").alias("unit"), "fp")
    else:
        cold = rows.join(large, ["band", "value"], "left_anti").select(F.xxhash64("band", "value").alias("unit"), "fp")
        hot = rows.join(parts, ["band", "value", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        units = cold.unionByName(hot.join(ends, ["band", "value", "ones", "part"]).select("unit", "fp"))
    # Units that share a hash are compared together, which finds no wrong link.
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lambda it: _compare(it, radius, tile), "a long, b long")


def classes(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 16_384) -> DataFrame:
    """Return (id_col, fp, component_id): the smallest id reachable over links."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, bucket_rows))
    placed = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
