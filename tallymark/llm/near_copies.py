"""Near copies by wide SimHash fingerprints and an exact check of the shingles, for pipelines.

A text's distinct ``size``-word shingles give a fingerprint of 256 bits.  The share of
bits in which two fingerprints differ estimates the angle between their shingle sets and
so the similarity (Jaccard) of the sets; texts are candidates when they differ in no more bits than
all but 5 % of the pairs of exactly ``similarity`` do.

Within a class of candidates the shingle sets themselves (64-bit hashes) are compared: texts
link when their sets' similarity is ``similarity`` or more.  All pairs of a class count, those
beyond the radius too; pairs that links already join are passed over.  A class over
``class_rows`` texts or ``CLASS_SHINGLES`` shingles is cut into parts, and each pair of parts is a unit of work.

A radius that wide fits no pigeonhole, so the tiles to compare come from tables of sampled
bits: each table deals the fingerprints into buckets by the bits it samples, and there are
as many tables as find a pair of ``similarity`` with a chance of 0.99 (closer pairs more
surely).  The bits a table samples follow the number of fingerprints, which keeps the
buckets' mean size.  A bucket is compared in tiles by exclusive-or and bit counts, all of
it: one over ``bucket_rows`` is cut into parts, and each pair of parts is a unit of work.

Defined cases: null and wordless texts are copies of each other; a text of fewer words
than a shingle is one shingle; rows with a null id are kept, as nothing tells them apart;
of rows with equal ids any one stays; a very long text is hashed whole; all columns are
returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import spread
from .common import fresh_name, give_back, materialise, text_rows
from .components import components
from .simhash import _forest

BITS, TILE = 256, 512
_EMPTY = bytes(BITS // 8)
#: Shingles of the texts that a task compares exactly at once.
CLASS_SHINGLES = 2_000_000


def _shingles(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def fingerprint(text: str | None, size: int = 5) -> bytes:
    """Majority of the bits of the 256-bit hashes of the distinct shingles; the least hash decides ties."""
    return _majority(_hashes(text, size))


def _hashes(text: str | None, size: int) -> list[bytes]:
    digest = xxhash.xxh3_128_digest
    return [digest(s, 1) + digest(s, 2) for s in _shingles(text, size)]


def _heads(hashes: list[bytes]) -> np.ndarray:
    """The set of shingles as sorted 64-bit numbers."""
    return np.unique(np.frombuffer(b"".join(hashes), np.int64).reshape(-1, BITS // 64)[:, 0])


def _named(heads: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    return xxhash.xxh3_64_intdigest(heads.tobytes()) - (1 << 63)


def _majority(hashes: list[bytes]) -> bytes:
    if not hashes:
        return _EMPTY
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = np.frombuffer(b"".join(hashes[at : at + (1 << 12)]), np.uint8)
        counts += np.unpackbits(part.reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    tie = np.unpackbits(np.frombuffer(min(hashes), np.uint8)).astype(bool)
    return np.packbits((2 * counts > len(hashes)) | ((2 * counts == len(hashes)) & tie)).tobytes()


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of one size and this similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float) -> int:
    p = differing(similarity)
    return int(BITS * p + 1.65 * math.sqrt(BITS * p * (1 - p)))


def samples(n: int, similarity: float, missed: float = 0.01, seed: int = 1) -> np.ndarray:
    """(tables, width): the bits that each table samples, for ``n`` fingerprints."""
    width = min(max(round(math.log2(max(n, 2))) - 8, 4), 30)
    same = (1 - differing(similarity)) ** width
    tables = max(1, math.ceil(math.log(missed) / math.log(1 - same)))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(BITS, width, replace=False) for _ in range(tables)])


def near_pairs(fps: np.ndarray, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """Spanning links of all fingerprints (rows of four uint64) within the radius."""
    found: list[tuple[int, int]] = []
    for i in range(0, len(fps), tile):
        a = fps[i : i + tile]
        for j in range(i, len(fps), tile):
            b = fps[j : j + tile]
            apart = np.zeros((len(a), len(b)), np.uint16)
            for k in range(fps.shape[1]):
                apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
            near = apart <= radius
            found += _forest(np.triu(near, 1) if i == j else near, i, j)
    return found


def _fingerprints(batches, names: list[str], size: int):
    """Rows (text's hash, text, id) to rows (id, text's hash, fp, node); texts of one set of shingles are one node."""
    for batch in batches:
        prints, nodes = [], []
        for _, text in text_rows([batch]):
            hashes = _hashes(text, size)
            prints.append(_majority(hashes))
            nodes.append(_named(_heads(hashes)))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(prints, pa.binary()), pa.array(nodes, pa.int64())], names=names)
    give_back()


def _sets(batches, size: int):
    """Rows (node, text, root) to rows (root, node, shingles)."""
    for batch in batches:
        sets = [_heads(_hashes(text, size)).tobytes() for _, text in text_rows([batch])]
        for at in range(0, len(sets), 64):  # of long texts a batch of Arrow's usual rows is large
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(sets[at : at + 64], pa.binary())], names=["root", "node", "shingles"])
    give_back()


def _buckets(batches, picks: np.ndarray):
    """Rows (node, fp) to rows (unit, node, fp), one a table."""
    weights = 1 << np.arange(picks.shape[1], dtype=np.int64)
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            n = part.num_rows
            bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, BITS // 8), axis=1)
            for t, pick in enumerate(picks):
                unit = (bits[:, pick] @ weights) | (t << 32)
                yield pa.RecordBatch.from_arrays([pa.array(unit), part.column(0), part.column(1)], names=["unit", "node", "fp"])


def _compare(batches, radius: int):
    """Rows (unit, node, fp) sorted by unit: spanning links of each unit's nodes."""
    units, nodes, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)

    def links(units, nodes, fps):
        cuts = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]])
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                own = nodes[a:b]
                for x, y in near_pairs(fps[a:b], radius):
                    left.append(int(own[x]))
                    right.append(int(own[y]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        units = np.concatenate([units, batch.column(0).to_numpy(zero_copy_only=False)])
        nodes = np.concatenate([nodes, batch.column(1).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, BITS // 64)])
        cut = int(np.searchsorted(units, units[-1]))  # the last unit may go on
        if cut:
            yield links(units[:cut], nodes[:cut], fps[:cut])
        units, nodes, fps = units[cut:], nodes[cut:], fps[cut:]
    if len(units):
        yield links(units, nodes, fps)


def links(nodes: DataFrame, similarity: float, bucket_rows: int = 8_192) -> DataFrame:
    """``nodes``: distinct (node long, fp binary).  Returns links (a, b) of near copies."""
    picks, radius = samples(nodes.count(), similarity), radius_of(similarity)
    rows = nodes.select("node", "fp").mapInArrow(lambda it: _buckets(it, picks), "unit long, node long, fp binary")
    large = rows.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    large = materialise(large.select("unit", F.ceil(2 * F.col("n") / bucket_rows).cast("int").alias("parts")), "near-large")
    if not large.isEmpty():
        # A part meets every part from itself on; a unit is a pair of parts.
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        hot = rows.join(large, "unit").withColumn("part", part)
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        hot = hot.select("unit", "node", "fp", "part", F.explode(others).alias("other"))
        hot = hot.select(F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "node", "fp")
        rows = rows.join(large, "unit", "left_anti").select("unit", "node", "fp").unionByName(hot)
    # Units that share a hash are compared together, which finds no wrong link.
    dealt = rows.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of all pairs of sets (sorted numbers) of the similarity or more.

    A set meets those that no link has reached yet, by the list of the sets that hold each of
    its numbers, so near copies of one text cost one comparison each.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    own = np.split(flat, np.cumsum(sizes)[:-1]) if len(sets) else []
    free, found = np.ones(len(sets), bool), []

    def listed():
        left = np.flatnonzero(free)
        holder = np.repeat(left, sizes[left])
        token = np.concatenate([own[k] for k in left]) if len(left) else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")
        return holder[order], np.searchsorted(token[order], np.arange(flat.max(initial=-1) + 2)), len(left)

    holder, starts, listed_n = listed()
    for root in range(len(sets)):
        queue = [root] if free[root] else []
        free[root] = False
        while queue:
            at = queue.pop()
            left = int(free.sum())
            if not left:
                return found
            if 2 * left < listed_n:
                holder, starts, listed_n = listed()
            first, n = starts[own[at]], starts[own[at] + 1] - starts[own[at]]
            shared = np.bincount(holder[spread(first, n)], minlength=len(sets))
            near = free & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9)
            fresh = np.flatnonzero(near)
            free[fresh] = False
            found += [(at, n) for n in fresh.tolist()]
            queue += fresh.tolist()
    return found


def _verify(batches, similarity: float):
    """Rows (unit, node, shingles) sorted by unit: spanning links of each unit's nodes."""
    unit, nodes, sets = None, [], []

    def links():
        found = alike(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for k, node, shingles in zip(*(batch.column(c) for c in range(3)), strict=True):
            if k.as_py() != unit:
                if len(nodes) > 1:
                    yield links()
                unit, nodes, sets = k.as_py(), [], []
            nodes.append(node.as_py())
            sets.append(np.frombuffer(shingles.as_py(), np.int64))
    if len(nodes) > 1:
        yield links()
    give_back()


def verified(sets: DataFrame, similarity: float, class_rows: int = 1_024) -> DataFrame:
    """``sets``: (root, node, shingles), the candidates of each class.  Returns links (a, b) of sets of the similarity or more."""
    sizes = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("shingles"))
    parts = F.ceil(2 * F.greatest(F.col("n") / class_rows, F.col("shingles") / CLASS_SHINGLES)).cast("int")
    large = materialise(sizes.where((F.col("n") > class_rows) | (F.col("shingles") > CLASS_SHINGLES)).select("root", parts.alias("parts")), "near-large")
    rows = sets.select(F.col("root").alias("unit"), "node", "shingles")
    if not large.isEmpty():
        # As in links: a part meets every part from itself on.
        hot = sets.join(large, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        hot = hot.select("root", "node", "shingles", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        hot = hot.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "node", "shingles")
        rows = sets.join(large, "root", "left_anti").select(F.col("root").alias("unit"), "node", "shingles").unionByName(hot)
    # Units that share a hash are compared together, which finds no wrong link.
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda it: _verify(it, similarity), "a long, b long")


def classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, component_id): the smallest id reachable over links."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.xxhash64(text).alias("hash"), text.alias("text"), F.col(id_col).alias("id"))
    names = ["id", "hash", "fp", "node"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("hash", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("node", T.LongType())])
    prints = materialise(source.mapInArrow(lambda it: _fingerprints(it, names, size), schema), "near-fingerprints")
    nodes = prints.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("hash").alias("hash"))
    nodes = materialise(nodes, "near-nodes")
    near = components(links(nodes, similarity)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Roots have no row of their own.
    near = materialise(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()), "near-candidates")
    # One text a candidate; documents meet the candidates by a merge at every size.
    wanted = near.join(nodes.select("node", "hash"), "node").select("hash", "node", "root")
    texts = source.select("hash", "text").join(wanted.hint("merge"), "hash").dropDuplicates(["node"]).select("node", "text", "root")
    sets = materialise(texts.mapInArrow(lambda it: _sets(it, size), "root long, node long, shingles binary"), "near-sets")
    roots = components(verified(sets, similarity)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("node", "root").join(ids, "root").select("node", "component_id")
    return prints.select(F.col("id").alias(id_col), "node").join(named, "node").select(id_col, "component_id")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with its smallest id."""
    kept, n = fresh_name("kept", docs.columns), fresh_name("n", docs.columns)
    found = classes(docs, size, similarity, id_col, text_col)
    own = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(kept)).agg(F.count("*").alias(n))
    own = materialise(own, "near-kept")
    match = F.col(id_col) == F.col(kept)
    # Documents meet the kept ids by a merge at every size: a list that fits a broadcast here doesn't at scale.
    out = docs.join(own.where(F.col(n) == 1).select(kept).hint("merge"), match, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    repeated = own.where(F.col(n) > 1).select(kept)
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(repeated, match, "left_semi").dropDuplicates([id_col]))
    return out
