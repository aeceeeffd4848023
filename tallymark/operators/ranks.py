"""Ranks, quantiles and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from .lineage import checkpointed
from .order import numbered, quantiles, ranks, running


def average_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1 within groups of any size; equal values share the mean of theirs.

    Distinct values are ranked by ranges of (group, value).  Both sides of the join that
    takes the ranks back to the rows are plain shuffles, so a frequent value's rows can be split.
    """
    return _with_ranks(df, ranks(df, value, by), value, out, by)


def _with_ranks(df: DataFrame, ranked: DataFrame, value: str, out: str, by: tuple[str, ...]) -> DataFrame:
    same = F.col(value) == F.col("_rv")
    for k, name in enumerate(by):
        same = same & F.col(name).eqNullSafe(F.col(f"_rg{k}"))
    named = ranked.select(*(F.col(name).alias(f"_rg{k}") for k, name in enumerate(by)), F.col(value).alias("_rv"), F.col("rank").alias(out))
    return df.join(named.hint("merge"), same, "left").select(*df.columns, out)


def group_rank(value: str, *by: str) -> Column:
    """Average rank as a window expression: for groups of a bounded size."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho; null if there are fewer than three rows or a side is constant."""
    ranked = _both_ranked(df, x, y, ())
    rho = F.when(F.count("*") >= 3, safe_corr("_rx", "_ry"))
    return ranked.agg(F.count("*").alias("n"), rho.alias("rho"))


def with_both_ranks(df: DataFrame, x: str, y: str, by: tuple[str, ...], rx: str, ry: str) -> DataFrame:
    """``df`` with the ranks of two columns within groups of any size; the two are placed in one pass."""
    rows = checkpointed(df, "to-rank")
    sides = [rows.select(*by, F.lit(k).alias("_side"), F.col(c).cast("double").alias("_v")) for k, c in enumerate((x, y))]
    placed = checkpointed(ranks(sides[0].unionByName(sides[1]), "_v", ("_side", *by)), "ranks")
    for k, (c, out) in enumerate(((x, rx), (y, ry))):
        rows = _with_ranks(rows, placed.where(F.col("_side") == k).select(*by, F.col("_v").alias(c), "rank"), c, out, by)
    return rows


def _both_ranked(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """(by, _rx, _ry): ranks of the rows that have both values."""
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    return with_both_ranks(rows, "_x", "_y", by, "_rx", "_ry")


def spearman_by(df: DataFrame, x: str, y: str, *by: str, least: int = 3) -> DataFrame:
    """n and rho of each group with at least ``least`` rows; groups of any size."""
    out = _both_ranked(df, x, y, by).groupBy(*by).agg(F.count("*").alias("n"), safe_corr("_rx", "_ry").alias("rho"))
    return out.where(F.col("n") >= least).withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


def quantile_bins(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Bins from 0, right-closed, cut at the i/k quantiles; equal cuts count once."""
    cuts = quantiles(df, value, [i / k for i in range(1, k)]).select(F.array_distinct("q").alias("_cuts"))
    number = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return df.join(F.broadcast(cuts)).withColumn(out, number.cast("int")).drop("_cuts")


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: the largest gap between the two samples' distribution functions."""
    both = a.select(value, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(value, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    seen = both.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = seen.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    steps = running(seen, [value], {"_ba": F.col("_a"), "_bb": F.col("_b")}).join(F.broadcast(total))
    steps = steps.withColumn("_ca", F.col("_ba") + F.col("_a")).withColumn("_cb", F.col("_bb") + F.col("_b"))
    gap = F.col("_ca") / F.nullif(F.col("_ta"), F.lit(0)) - F.col("_cb") / F.nullif(F.col("_tb"), F.lit(0))
    return steps.agg(F.max(F.abs(gap)).alias("ks"))


def spread_picks(df: DataFrame, order: list, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``k`` rows at even steps of the order, first and last included (all, if fewer)."""
    if by:
        w = Window.partitionBy(*by)
        ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    else:
        ranked = numbered(df, order).join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))).cast("long"))
    return ranked.where(F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def value_gaps(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the distance to the next larger one."""
    seen = numbered(df.select(value).distinct(), [value])
    above = seen.select((F.col("_i") - 1).alias("_i"), F.col(value).alias("_next"))
    return seen.join(above, "_i", "left").select(value, (F.col("_next") - F.col(value)).alias("gap"))
