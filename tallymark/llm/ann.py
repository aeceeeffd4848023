"""Nearest neighbours by a hash-prefix forest.

Rows are dealt into shards of bounded size and queries into blocks of bounded size (both in
components, so longer vectors make smaller ones); a unit of work is one shard and one block.  For its shard it builds ``trees`` sorted arrays of
hash strings (the signs of random projections, most significant bit first).  A query
descends each array to its longest matching prefix by binary search; all trees then ascend
together, a bit at a time, until the matched ranges hold enough rows.  The rows in those
ranges are scored exactly in double precision.

How many rows are enough depends on the data: a unit compares up to ``SAMPLE`` of its
queries with its whole shard and takes the smallest step that finds ``recall`` of their
nearest rows.  The last step takes every row.

Largest inner product is turned into an angle by one more coordinate, the root of what a
row's squared length lacks of the shard's largest.  Exact copies of a vector count once:
the smallest ids of each (as many as can matter) stand for it.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
with a null id, take no part; vectors are compared with those of their own length; repeated
rows count once; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Components in a shard and a block: of 64 dimensions, 32,768 rows and 16,384 queries.
SHARD_VALUES, BLOCK_VALUES = 1 << 21, 1 << 20
TREES, BITS, RECALL, SAMPLE = 128, 32, 0.96, 64
#: Rows in the matched ranges of all trees, as a multiple of the shard's; each is a step.
STEPS = tuple(2 ** (i / 2) for i in range(-8, 10))
#: Queries whose ranges are held at once.
QUERIES_AT_ONCE = 1024


def _codes(x: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """uint32 hash strings of up to 32 bits, one row a tree."""
    out = np.empty((trees, len(x)), np.uint32)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    for t in range(trees):
        out[t] = ((x @ planes[:, t * bits : (t + 1) * bits]) > 0).astype(np.uint32) @ weights
    return out


class Forest:
    """Sorted arrays of the rows' hash strings, one a tree."""

    def __init__(self, rows: np.ndarray, trees: int, bits: int, seed: int = 1):
        lengths = np.einsum("ij,ij->i", rows, rows)
        extended = np.column_stack([rows, np.sqrt(np.maximum(lengths.max() - lengths, 0))])
        self.planes = np.random.default_rng(seed).standard_normal((extended.shape[1], trees * bits))
        codes = _codes(extended, self.planes, trees, bits)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)
        self.rows, self.trees, self.bits = rows, trees, bits

    def candidates(self, queries: np.ndarray, share: float):
        """Yield for each query the indexes of its candidate rows."""
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            yield from self._candidates(queries[at : at + QUERIES_AT_ONCE], share)

    def _candidates(self, queries: np.ndarray, share: float):
        trees, bits = self.trees, self.bits
        query_codes = _codes(np.column_stack([queries, np.zeros(len(queries))]), self.planes, trees, bits)
        low = np.zeros((trees, len(queries)), np.int64)
        high = np.full((trees, len(queries)), len(self.rows), np.int64)
        open_ = np.ones(len(queries), bool)
        for level in range(bits, 0, -1):  # all trees ascend together
            shift = np.uint32(bits - level)
            found = np.empty((2, trees, len(queries)), np.int64)
            for t in range(trees):
                start = (query_codes[t] >> shift) << shift
                found[0, t] = np.searchsorted(self.codes[t], start, "left")
                found[1, t] = np.searchsorted(self.codes[t], start | np.uint32((1 << int(shift)) - 1), "right")
            enough = open_ & ((found[1] - found[0]).sum(axis=0) >= max(1, share * len(self.rows)))
            low[:, enough], high[:, enough] = found[0][:, enough], found[1][:, enough]
            open_ &= ~enough
            if not open_.any():
                break
        mark = np.zeros(len(self.rows), bool)
        for q in range(len(queries)):
            mark[:] = False
            for t in range(trees):
                mark[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(mark)

    def share(self, queries: np.ndarray, k: int, recall: float) -> float:
        """The smallest step that finds ``recall`` of the sampled queries' nearest rows."""
        sample = queries[:: max(1, len(queries) // SAMPLE)][:SAMPLE]
        # One more than k: the query's own vector may be among them.
        best = [set(np.argsort(-(self.rows @ q), kind="stable")[: k + 1].tolist()) for q in sample]
        for step in STEPS:
            hits = sum(len(b & set(f.tolist())) for b, f in zip(best, self.candidates(sample, step), strict=True))
            if hits >= recall * sum(map(len, best)):
                return step
        return float(self.trees + 1)


def _best(rows: pd.DataFrame, queries: pd.DataFrame, k: int, trees: int, bits: int, recall: float) -> pd.DataFrame:
    out: list[tuple] = []
    if len(rows) and len(queries):
        x, q = np.array(rows["v"].tolist(), np.float64), np.array(queries["v"].tolist(), np.float64)
        ids = rows["ids"].tolist()
        forest = Forest(x, trees, bits)
        share = forest.share(q, k, recall)
        for i, (own, found) in enumerate(zip(queries["query_id"].tolist(), forest.candidates(q, share), strict=True)):
            near = (x[found] * q[i]).sum(axis=1)
            if len(found) > k + 1:
                found, near = found[keep := near >= np.partition(near, -k - 1)[-k - 1]], near[keep]
            best = sorted((-s, v) for s, f in zip(near.tolist(), found.tolist(), strict=True) for v in ids[f] if v != own)[:k]
            out += [(own, v, -s) for s, v in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, is_query, k: int = 20, trees: int = TREES, bits: int = BITS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", shard_values: int = SHARD_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Return query_id, rank, vec_id and score; ``is_query`` is a condition on column ``id``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()
    # The rank's limit is applied before the shuffle, so a common vector is not gathered.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    unique = materialise(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    queries = materialise(rows.where(is_query), "vector-queries")
    values = lambda df: df.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    shards, blocks = max(1, -(-values(unique) // shard_values)), max(1, -(-values(queries) // block_values))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = unique.select(deal("v", shards).alias("shard"), F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "v", "ids")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), deal("id", blocks).alias("block"), F.col("id").alias("query_id"), "v")
    keys = ("shard", "block", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _best(a, b, k, trees, bits, recall), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
