"""Likelihoods of strings with each position masked in turn: alone, in a group's context, and their difference.

Counts of training strings take the place of a network's logits.  A masked letter is
predicted from its place and neighbours, backing off to its place alone; in context the
group's own counts at that place come first and back off to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_cells(text: Column, length: int) -> Column:
    """Array of (p, a, l, r): each position from 1, its letter and its neighbours (empty beyond an end)."""
    at = lambda p: F.substring(text, p, 1) if 1 <= p <= length else F.lit("")
    return F.array(*(F.struct(F.lit(p).alias("p"), at(p).alias("a"), at(p - 1).alias("l"), at(p + 1).alias("r")) for p in range(1, length + 1)))


def _counts(cells: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(keys, a, name) and (keys, name_all): how often a letter, and any letter, has the keys."""
    one = cells.groupBy(*keys, "a").agg(F.count("*").alias(name))
    return one, cells.groupBy(*keys).agg(F.count("*").alias(f"{name}_all"))


def masked_likelihood(train: DataFrame, rows: DataFrame, grp: str, text: str, length: int, letters: int, strength: float = 4.0) -> DataFrame:
    """(grp, text, alone, in_context, delta): sums of log probabilities over the masked positions of each distinct pair.

    ``strength`` rows' worth of the wider prediction stand behind each narrower one, and one
    of each of ``letters`` letters behind the widest, so an unseen group or letter is scored too.
    Rows without a group or text take no part.  The tables of places and neighbours grow with
    the alphabet's third power and are broadcast; the groups' are joined by shuffles.
    """
    spread = lambda df: df.select(F.col(grp).alias("g"), F.col(text).alias("t"), F.explode(masked_cells(F.col(text), length)).alias("x")).select("g", "t", "x.*")
    known = lambda df: df.where(F.col(grp).isNotNull() & F.col(text).isNotNull()).select(grp, text)
    cells = spread(known(train))
    scored = spread(known(rows).distinct())
    for keys, name, narrow in ((["p"], "c1", True), (["p", "l", "r"], "c2", True), (["g", "p"], "c3", False)):
        one, every = _counts(cells, keys, name)
        place = F.broadcast if narrow else (lambda df: df.hint("merge"))
        scored = scored.join(place(one), [*keys, "a"], "left").join(place(every), keys, "left").na.fill(0, [name, f"{name}_all"])
    wide = (F.col("c1") + 1) / (F.col("c1_all") + F.lit(float(letters)))
    near = (F.col("c2") + strength * wide) / (F.col("c2_all") + F.lit(strength))
    own = (F.col("c3") + strength * near) / (F.col("c3_all") + F.lit(strength))
    out = scored.groupBy("g", "t").agg(F.sum(F.log(near)).alias("alone"), F.sum(F.log(own)).alias("in_context"))
    return out.select(F.col("g").alias(grp), F.col("t").alias(text), "alone", "in_context", (F.col("in_context") - F.col("alone")).alias("delta"))
