"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in Spark; only a count and a checksum of them reach the driver.  Each round
is written to the shared folder, so a lost executor re-reads the last round.  Of many
edges the smallest neighbours are written too: then both sides of the join with them are
plain shuffles, and Spark splits the edges of a hub over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges above which the edges of one node may be too many for a task.
SPLIT_EDGES = 1_000_000


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node) of a forest with the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def _contract(batches):
    for batch in batches:
        found = spanning(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        columns = list(zip(*found, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges``: a long, b long.  Returns (a, b): each node that isn't its own root, and its root.

    The root is the smallest node of the component.  No edges give no rows.
    """
    now = edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long")
    now = materialise(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, most = None, now.count()

    def plain(df: DataFrame) -> DataFrame:
        return materialise(df, "least") if most > SPLIT_EDGES else df

    for _ in range(most_rounds):
        # Large star: neighbours above a node link to the smallest of it and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = plain(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of those.
        least = plain(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        now = materialise(small.distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now
        state = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
