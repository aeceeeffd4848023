"""Matrix and vector analytics on array columns and on long matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .order import running


def cells(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, i, j, x): a flat vector read as rows of ``width``."""
    long = df.select(key, F.posexplode(vector).alias("k", "x"))
    return long.select(key, F.floor(F.col("k") / width).cast("int").alias("i"), (F.col("k") % width).alias("j"), F.col("x").cast("double").alias("x"))


def mean_pool(vector: Column, rows: int, width: int) -> Column:
    """The mean over the rows of a flat matrix."""
    at = lambda j: sum((F.get(vector, i * width + j).cast("double") for i in range(1, rows)), F.get(vector, j).cast("double")) / F.lit(float(rows))
    return F.array(*(at(j) for j in range(width)))


def pair_l1(df: DataFrame, key: str, vector: str, mask: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, dist): mean absolute difference of all pairs of a group, over the cells where ``mask`` of ``k`` holds.

    Pairs of one group are all compared: groups are structures of a bounded size, and have to be named.
    """
    if not by:
        raise ValueError("pairs of all rows are not compared: name the groups")
    left = df.select(*by, F.col(key).alias("a"), F.col(vector).alias("_va"))
    right = df.select(*by, F.col(key).alias("b"), F.col(vector).alias("_vb"))
    met = left.join(right, list(by)).where("a < b")
    both = met.select(*by, "a", "b", F.posexplode(F.zip_with("_va", "_vb", lambda x, y: F.abs(x.cast("double") - y.cast("double")))).alias("k", "x"))
    both = both.where(mask) if mask is not None else both
    return both.groupBy(*by, "a", "b").agg(F.avg("x").alias("dist"))


def sample_variance(long: DataFrame, entity: str, sample: str, cell: str, value: str) -> DataFrame:
    """(cell, within, across): mean absolute difference of an entity's two samples (0 and 1), and of all pairs of entities' first samples.

    The sum over all pairs of a cell follows from each value's place in the cell's order: a
    value at place i of n is the larger of i pairs and the smaller of n - 1 - i.  No pair is made.
    """
    rows = checkpointed(long.where(F.col(value).isNotNull()).select(F.col(entity).alias("e"), F.col(sample).alias("s"), F.col(cell).alias("k"), F.col(value).cast("double").alias("x")), "samples")
    both = rows.groupBy("e", "k").agg(F.max(F.when(F.col("s") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("s") == 1, F.col("x"))).alias("b"))
    within = both.where("a is not null and b is not null").groupBy("k").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("within"))
    # Equal values are counted together: their pairs differ by nothing, and a frequent value is one row.
    seen = rows.where("s = 0").groupBy("k", "x").agg(F.count("*").alias("n"))
    placed = running(seen, ["x"], {"before": F.col("n")}, ("k",), whole=True)
    signed = F.col("x") * F.col("n") * (F.col("before") - (F.col("before_all") - F.col("before") - F.col("n"))).cast("double")
    n = F.max("before_all").cast("double")
    across = placed.groupBy("k").agg((F.sum(signed) / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("across"))
    return across.join(within, "k", "full").select(F.col("k").alias(cell), "within", "across")


def contact_set(long: DataFrame, limit: float, *by: str) -> DataFrame:
    """(by, i, j): cells whose smallest value over a group's entities is under the limit."""
    return long.groupBy(*by, "i", "j").agg(F.min("x").alias("least")).where(F.col("least") < limit).select(*by, "i", "j")


def pca_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, retained): the share of variance that each principal component of a few columns retains.

    Only their covariances reach the driver.
    """
    cells = [(a, b) for a in columns for b in columns]
    row = df.agg(*(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in cells)).first()
    values = np.linalg.eigvalsh(np.array([x or 0.0 for x in row], float).reshape(len(columns), -1))[::-1]
    total = values.sum() or 1.0
    return df.sparkSession.createDataFrame([(i, float(v / total)) for i, v in enumerate(values)], "component int, retained double")


def min_distance(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """(by, i, j, d): smallest Euclidean distance between two residues' atoms (by, i, x, y, z) and (by, j, x, y, z)."""
    a = left.select(*by, "i", *(F.col(c).alias(f"_a{c}") for c in "xyz"))
    b = right.select(*by, "j", *(F.col(c).alias(f"_b{c}") for c in "xyz"))
    square = sum(((F.col(f"_a{c}") - F.col(f"_b{c}")) * (F.col(f"_a{c}") - F.col(f"_b{c}")) for c in "yz"), (F.col("_ax") - F.col("_bx")) * (F.col("_ax") - F.col("_bx")))
    if not by:
        raise ValueError("atoms of all rows are not compared: name the groups")
    met = a.join(b, list(by))
    return met.groupBy(*by, "i", "j").agg(F.sqrt(F.min(square)).alias("d"))
