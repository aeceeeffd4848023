"""Places and running sums in an order of all rows or of each group's, with no task that sees them all.

Rows are dealt into ranges of (group, order) and written with their range's number, so a
group of any size is cut where a range ends.  A range's start in a group is the sum of the
group's earlier ranges; only the first group of a range can have begun before it, so the
starts are a table of at most one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_part``, its range of the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list, sums: dict[str, Column], by: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """``df`` with running sums of the rows before each in its group; ``order`` should leave no ties.

    ``order`` names columns, or gives ascending expressions.  Null keys of ``by`` are a group.
    With ``whole``, ``<name>_all`` are the sums over the whole group.
    """
    group = F.struct(*by) if by else F.lit(0)
    named = df.select("*", group.alias("_g"), *(o.alias(f"_o{k}") if isinstance(o, Column) else F.col(o).alias(f"_o{k}") for k, o in enumerate(order)), *(c.alias(f"_v_{n}") for n, c in sums.items()))
    keys = [f"_o{k}" for k in range(len(order))]
    rows = ranged(named, ["_g", *keys] if by else keys)
    part = Window.partitionBy("_part", "_g")
    inner = part.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_g")  # over totals: at most one row a range
    outer = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", "_g").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    # Groups that lie in several ranges are the first or last of each.
    cut = totals.select("_part", "_g", F.count("*").over(every).alias("_k"), *(F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_s_{n}") for n in sums), *(F.sum(f"_t_{n}").over(every).alias(f"_a_{n}") for n in sums)).where("_k > 1").drop("_k")
    own = rows.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)).alias(f"_w_{n}") for n in sums), *(F.sum(f"_v_{n}").over(part).alias(f"_l_{n}") for n in sums if whole))
    both = own.join(F.broadcast(cut), ["_part", "_g"], "left")
    before = [(F.col(f"_w_{n}") + F.coalesce(F.col(f"_s_{n}"), F.lit(0))).alias(n) for n in sums]
    return both.select(*df.columns, *before, *(F.coalesce(F.col(f"_a_{n}"), F.col(f"_l_{n}")).alias(f"{n}_all") for n in sums if whole))


def numbered(df: DataFrame, order: list, out: str = "_i", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place in the order of its group, from 0."""
    return running(df, order, {out: F.lit(1).cast("long")}, by)


def _counted(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, value, _n): distinct values that aren't null, counted before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))


def ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, rank): each distinct value's average rank in its group, from 1; equal values share the mean of theirs."""
    placed = running(_counted(df, value, by), [value], {"_before": F.col("_n")}, by)
    return placed.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias("rank"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q): exact quantiles of each group at ``shares``, an array in their order.

    Values between two neighbours are weighted by their distance.  Distinct values are
    counted and placed; of a group only the values at the wanted places go on, so no buffer
    holds a group.  Nulls don't count; a group of nulls has no row, and without groups an
    empty input gives one row with a null.
    """
    placed = running(_counted(df, value, by), [value], {"_before": F.col("_n")}, by, whole=True)
    wanted = []
    for share in shares:
        at = (F.col("_before_all") - 1) * F.lit(float(share))
        wanted += [F.floor(at), F.ceil(at)]
    holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
    some = placed.withColumn("_at", F.array(*wanted)).where(F.exists("_at", holds))
    picked = some.groupBy(*by).agg(*(F.max(F.when(holds(F.get("_at", k)), F.col(value).cast("double"))).alias(f"_q{k}") for k in range(len(wanted))), F.max("_before_all").alias("_size"))
    out = []
    for k, share in enumerate(shares):
        at = (F.col("_size") - 1) * F.lit(float(share))
        low, high = F.col(f"_q{2 * k}"), F.col(f"_q{2 * k + 1}")
        out.append(F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at))))
    return picked.select(*by, F.when(F.col("_size").isNotNull(), F.array(*out)).alias("q"))


def median(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, out): the exact median of each group."""
    return quantiles(df, value, [0.5], by).select(*by, F.get("q", 0).alias(out))
