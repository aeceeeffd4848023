"""Guards, foils, sweeps and ablations over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr, safe_divide, uniform


def representativeness(rows: DataFrame, entity: str, grp: str, low: float = 0.85, high: float = 1.15, split: str = "split", part: str = "test") -> DataFrame:
    """One row: groups an entity in ``part`` and in the rest, their ratio, and whether it is within bounds."""
    each = rows.select(split, entity, grp).distinct().groupBy(split, entity).agg(F.count("*").alias("k"))
    inside = F.col(split) == part
    means = each.agg(F.avg(F.when(inside, F.col("k"))).alias("inside"), F.avg(F.when(~inside, F.col("k"))).alias("outside"))
    ratio = F.col("inside") / F.nullif(F.col("outside"), F.lit(0.0))
    return means.withColumn("ratio", ratio).withColumn("ok", F.col("ratio").between(low, high))


def row_split(rows: DataFrame, keys: list[str], share: float, tag: str = "foil") -> DataFrame:
    """``rows`` with ``held``: a split by row, whatever the entity; a foil for splits by entity."""
    return rows.withColumn("held", uniform(tag, *(F.col(k) for k in keys)) < share)


def group_z_score(train: DataFrame, rows: DataFrame, grp: str, y: str, out: str = "z") -> DataFrame:
    """z-scores by the training mean and sample deviation of a row's group.

    Groups that training lacks, or that have one training row, take those of all training rows.
    """
    own = train.groupBy(grp).agg(F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s"))
    whole = train.agg(F.avg(y).alias("_am"), F.stddev_samp(y).alias("_as"))
    known = F.col("_s").isNotNull()
    z = safe_divide(F.col(y) - F.when(known, F.col("_m")).otherwise(F.col("_am")), F.when(known, F.col("_s")).otherwise(F.col("_as")))
    return rows.join(own, grp, "left").join(F.broadcast(whole)).withColumn(out, z).drop("_m", "_s", "_am", "_as")


def sweep(rows: DataFrame, y: str, models: list[str], factors: list[float]) -> DataFrame:
    """(model, factor, rmse, chosen): each model shrunk to its mean by each factor; the best of a model is chosen."""
    means = rows.agg(*(F.avg(m).alias(f"_m_{m}") for m in models))
    grid = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(f).alias("factor"), (F.col(f"_m_{m}") + F.lit(f) * (F.col(m) - F.col(f"_m_{m}"))).alias("p")) for m in models for f in factors))
    each = rows.select(y, *models).join(F.broadcast(means)).select(y, F.explode(grid).alias("g")).select(y, "g.*")
    table = each.groupBy("model", "factor").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col(y), 2))).alias("rmse"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.round("rmse", 9), "factor"))
    return table.withColumn("chosen", place == 1)


def position_scores(train: DataFrame, text: str, y: str, length: int) -> DataFrame:
    """(position, letter, effect): the mean training value of the rows with the letter at the position."""
    cells = train.select(y, F.posexplode(F.split(F.substring(text, 1, length), "")).alias("position", "letter"))
    return cells.groupBy("position", "letter").agg(F.avg(y).alias("effect"))


def position_ablation(train: DataFrame, rows: DataFrame, key: list[str], text: str, y: str, length: int) -> DataFrame:
    """(position, full, ablated, fall): Pearson of an additive scorer with all positions, and without one.

    The scores of a row without each position are differences from its whole score, so
    no row is scored ``length`` times.  Letters that training lacks add nothing.
    """
    cells = rows.select(*key, y, F.posexplode(F.split(F.substring(text, 1, length), "")).alias("position", "letter"))
    scored = cells.join(F.broadcast(position_scores(train, text, y, length)), ["position", "letter"], "left").withColumn("e", F.coalesce("effect", F.lit(0.0)))
    whole = scored.withColumn("full_score", F.sum("e").over(Window.partitionBy(*key))).withColumn("rest", F.col("full_score") - F.col("e"))
    out = whole.groupBy("position").agg(safe_corr("full_score", y).alias("full"), safe_corr("rest", y).alias("ablated"))
    return out.withColumn("fall", F.col("full") - F.col("ablated"))


def verdict(mean: Column, low: Column, high: Column, noise: float) -> Column:
    """How a difference reads: its interval spans zero, it is within seed noise, or it survives."""
    return F.when((low <= 0) & (high >= 0), "spans zero").when(F.abs(mean) <= noise, "within seed noise").otherwise("survives")


def extremes(table: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest and the k with the smallest ``value``, by ``key`` on ties; ``side`` tells which."""
    tops = [table.where(F.col(value).isNotNull()).orderBy(way(value), key).limit(k).withColumn("side", F.lit(side)) for way, side in ((F.desc, "top"), (F.asc, "bottom"))]
    return tops[0].unionByName(tops[1])


def null_gate(table: DataFrame, value: str, bound: float) -> DataFrame:
    """``table``, failing at run time if a null control's ``value`` lies further from zero than ``bound``."""
    checked = F.when(F.abs(value) > bound, F.raise_error(F.concat(F.lit("the null control is off: "), F.col(value))).cast("double")).otherwise(F.col(value))
    return table.withColumn(value, checked)


def audit(checks: list[tuple[str, DataFrame, float, float]]) -> DataFrame:
    """(check, value, ok) of one-row tables, with the bounds of each, and a last row ``all`` that counts the failures."""
    out = None
    for name, table, low, high in checks:
        value = F.col(table.columns[0]).cast("double")
        one = table.select(F.lit(name).alias("check"), value.alias("value"), F.coalesce(value.between(low, high), F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    failed = out.agg(F.lit("all").alias("check"), F.sum((~F.col("ok")).cast("double")).alias("value"))
    return out.unionByName(failed.withColumn("ok", F.col("value") == 0))


def require_audit(table: DataFrame) -> None:
    """Raise if a check of :func:`audit` failed."""
    failed = [r["check"] for r in table.where("NOT ok AND check <> 'all'").collect()]  # a row a check
    if failed:
        raise ValueError(f"failed: {', '.join(sorted(failed))}")


def feature_sets(train: DataFrame, rows: DataFrame, text: str, y: str, length: int, sets: dict[str, list[int]], times: str | None = None) -> DataFrame:
    """(set, n, r): Pearson of an additive scorer that sees some positions (from 1) only, for each named set.

    With ``times`` a row stands for so many equal ones: its scores are added up, and ``n`` counts
    the values of the row that has the fewest.

    The effects of letters are a small table, a literal of the plan; rows are not shuffled.
    """
    effects = position_scores(train, text, y, length).where("letter <> ''").collect()  # positions times letters
    pairs = [F.lit(v) for r in effects for v in (f"{r['position'] + 1}{r['letter']}", r["effect"])]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    value = lambda p: F.coalesce(F.try_element_at(known, F.concat(F.lit(str(p)), F.substring(text, p, 1))), F.lit(0.0))
    count = F.col(times).cast("long") if times else F.lit(1).cast("long")
    scored = rows.select(y, count.alias("_k"), F.array(*(value(p) for p in range(1, length + 1))).alias("_e"))
    total = lambda places: sum((F.get("_e", p - 1) for p in places), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(n).alias("set"), (F.col("_k") * len(p)).alias("n"), F.round(F.col("_k") * total(sorted(p)), 12).alias("s")) for n, p in sets.items()))
    return scored.select(y, F.explode(each).alias("x")).select(y, "x.*").groupBy("set").agg(F.min("n").alias("n"), safe_corr("s", y).alias("r"))
