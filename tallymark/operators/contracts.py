"""Data contracts: checked joins, required conditions and audits of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing at run time on the first row that breaks the condition (null breaks it)."""
    column = df.columns[0]
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(column)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[column].dataType))
    return df.withColumn(column, checked)


def many_to_one(left: DataFrame, right: DataFrame, *keys: str, complete: bool = True) -> DataFrame:
    """Inner join that keeps every left row exactly once.

    A key that is repeated on the right fails at run time, and so does (if ``complete``) a
    left row without a partner.  Both checks are part of the one join.
    """
    others = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in others))
    joined = left.join(one, list(keys), "left")
    if not complete:
        joined = joined.where(F.col("_n").isNotNull())
    text = F.when(F.col("_n").isNull(), F.lit("no partner for a row of the left side")).otherwise(F.lit("a key is repeated on the right side"))
    checked = require_one(joined, text)
    return checked.select(*left.columns, *others)


def with_partners(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join for keys that are names and may be shared: a left row comes once for each partner.

    A left row without a partner fails at run time, except one with a null key, which joins nothing.
    Both sides meet in the order of their keys, never by broadcast, so the rows of a name come
    together, its partners again and again: what is written of them is small, however many they are.
    """
    others = [c for c in right.columns if c not in keys]
    known = left.where(" and ".join(f"`{k}` is not null" for k in keys))
    joined = known.join(right.withColumn("_n", F.lit(1)).hint("merge"), list(keys), "left")
    return require_one(joined, F.lit("no partner for a row of the left side")).select(*left.columns, *others)


def require_one(joined: DataFrame, text: Column) -> DataFrame:
    column = joined.columns[0]
    return joined.withColumn(column, F.when(F.coalesce(F.col("_n") == 1, F.lit(False)), F.col(column)).otherwise(F.raise_error(text).cast(joined.schema[column].dataType)))


def chained(left: DataFrame, *steps: tuple, join=many_to_one) -> DataFrame:
    """Checked joins one after another, many-to-one unless said otherwise; a step is (right, key, ...)."""
    for right, *keys in steps:
        left = join(left, right, *keys)
    return left


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the order.  An aggregate, so a frequent key's rows meet pre-reduced."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *(F.col(f"_first.`{c}`").alias(c) for c in rest)).select(df.columns)


def concat_dedup_head(frames: list[DataFrame], keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of all frames together, each key once."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return keep_first(whole, keys, order).orderBy(*order).limit(k)


def key_union(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def completeness(rows: DataFrame, entity: str, part: str) -> DataFrame:
    """One row: distinct entities, the sum of the parts' distinct entities, and whether they are equal."""
    parts = rows.select(part, entity).distinct().agg(F.count("*").alias("parts"))
    whole = rows.select(entity).distinct().agg(F.count("*").alias("whole"))
    return whole.join(parts).withColumn("complete", F.col("whole") == F.col("parts"))


def distinct_then_scatter(rows: DataFrame, key: str, encode) -> DataFrame:
    """``encode`` applied to the distinct keys only, joined back to every row: a key's cost is paid once."""
    return rows.join(encode(rows.select(key).distinct()), key)


def bank(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(index, key, vector): stored vectors with the place of each key in order, from 0."""
    return numbered(df.select(key, vector), [key], "index")


def gather(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``rows`` with the index and vector of their key; a key that the bank lacks is an error."""
    return many_to_one(rows, stored, key)


def left_with_flag(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join with a column ``matched``."""
    return left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seen_share(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """One row: the rows, and the share whose key is among the known."""
    flagged = left_with_flag(rows.select(*keys), known.select(*keys).distinct(), *keys)
    return flagged.agg(F.count("*").alias("n"), F.avg(F.col("matched").cast("double")).alias("coverage"))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def split_overlaps(rows: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """For each pair of splits the entities that both hold."""
    own = rows.select(entity, split).distinct()
    a, b = own.select(entity, F.col(split).alias("split_a")), own.select(entity, F.col(split).alias("split_b"))
    pairs = a.join(b, entity).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))
    names = own.select(split).distinct()
    every = names.select(F.col(split).alias("split_a")).join(F.broadcast(names.select(F.col(split).alias("split_b"))), F.col("split_a") < F.col("split_b"))
    return every.join(pairs, ["split_a", "split_b"], "left").select("split_a", "split_b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def alignment_mismatches(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys of one prediction table that the other lacks, with the side that has them."""
    left = a.select(*keys).join(b, list(keys), "left_anti").withColumn("side", F.lit("a"))
    return left.unionByName(b.select(*keys).join(a, list(keys), "left_anti").withColumn("side", F.lit("b")))
