"""Metric algebra.  An undefined statistic is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp0, safe_corr, safe_divide
from .lineage import checkpointed
from .order import median
from .ranks import average_rank, group_rank, spearman, spearman_by

#: Rows that a group needs for a statistic of its own.
MIN_ROWS = 12


def errors(y: str, p: str) -> dict[str, Column]:
    """Errors on the log scale, and in hours after the prediction is clipped at zero."""
    e = F.col(p) - F.col(y)
    hours = F.expm1(clamp0(F.col(p))) - F.expm1(F.col(y))
    return {"rmse_log": F.sqrt(F.avg(e * e)), "mae_log": F.avg(F.abs(e)), "mae_hours": F.avg(F.abs(hours))}


def record(df: DataFrame, y: str, p: str, grp: str, least: int = MIN_ROWS) -> DataFrame:
    """One row: n, pooled and within-group Spearman, groups supported, Pearson and errors."""
    rows = checkpointed(df.select(y, p, grp), "scored")  # read seven times below
    whole = rows.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, safe_corr(y, p)).alias("pearson_log"), *(c.alias(n) for n, c in errors(y, p).items()))
    pooled = spearman(rows, y, p).select(F.col("rho").alias("spearman_pooled"))
    within = spearman_by(rows, y, p, grp, least=least).agg(F.avg("rho").alias("spearman_within"), F.count("rho").alias("groups_supported"))
    return whole.join(pooled).join(within).select("n", "spearman_pooled", "spearman_within", "groups_supported", "pearson_log", "rmse_log", "mae_log", "mae_hours")


def operational(df: DataFrame, y: str, p: str, short: float = 2.0, long: float = 24.0) -> DataFrame:
    """Mean and median error in hours, unclipped, and the mean in the strata up to ``short`` and over ``long``.

    expm1 of a logarithm is not exact, so a value equal to a limit belongs to the lower stratum.
    """
    t = F.expm1(F.col(y))
    rows = checkpointed(df.select(t.alias("t"), F.abs(F.expm1(F.col(p)) - t).alias("e")), "errors")
    means = rows.agg(F.avg("e").alias("mae_hours_raw"), F.avg(F.when(F.col("t") <= short + 1e-9, F.col("e"))).alias("mae_short"), F.avg(F.when(F.col("t") > long + 1e-9, F.col("e"))).alias("mae_long"))
    return means.join(median(rows, "e", "median_hours")).select("mae_hours_raw", "median_hours", "mae_short", "mae_long")


def calibration(df: DataFrame, y: str, p: str) -> DataFrame:
    bias = F.avg(F.expm1(F.col(p)) - F.expm1(F.col(y)))
    varies = F.min(p) < F.max(p)
    return df.agg(F.when(varies, F.regr_slope(y, p)).alias("slope"), F.when(varies, F.regr_intercept(y, p)).alias("intercept"), bias.alias("bias_hours"))


def top_k_precision(df: DataFrame, y: str, p: str, grp: str, key: str, k: int) -> DataFrame:
    """Mean share of a group's true top k that the prediction's top k holds; groups of 2k rows or more.

    Ties go to the smaller key.
    """
    w = Window.partitionBy(grp)
    ranked = df.select(grp, F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc(y), key)).alias("a"), F.row_number().over(w.orderBy(F.desc(p), key)).alias("b"))
    hits = ranked.where(F.col("n") >= 2 * k).groupBy(grp).agg(F.sum(((F.col("a") <= k) & (F.col("b") <= k)).cast("double")).alias("hits"))
    return hits.agg(F.lit(k).alias("k"), F.avg(F.col("hits") / k).alias("precision"), F.count("*").alias("groups"))


def skill_table(df: DataFrame, y: str, p: str, grp: str, least: int = MIN_ROWS) -> DataFrame:
    rows = checkpointed(df.select(grp, y, p), "skill")
    return spearman_by(rows, y, p, grp, least=least).join(median(rows, y, "median_y", (grp,)), grp).where(F.col("rho").isNotNull())


def skill_vs_support(df: DataFrame, y: str, p: str, grp: str) -> DataFrame:
    """Whether groups with more rows or larger values are predicted better."""
    table = checkpointed(skill_table(df, y, p, grp), "skill-table")
    a = spearman(table, "n", "rho").select(F.col("rho").alias("rho_n"), F.col("n").alias("groups"))
    return a.join(spearman(table, "median_y", "rho").select(F.col("rho").alias("rho_median")))


def auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Area under the ROC curve by ranks; null with one class."""
    ranked = average_rank(df.select(label.cast("int").alias("_l"), score), score, "_r").where(F.col("_l").isNotNull())
    ones = F.sum("_l").cast("double")
    zeros = F.sum(1 - F.col("_l")).cast("double")
    return ranked.agg(((F.sum(F.col("_l") * F.col("_r")) - ones * (ones + 1) / 2) / F.nullif(ones * zeros, F.lit(0.0))).alias("auc"))


def residual_correlation(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """Correlation of the models' rank residuals, one row a pair."""
    ranked = average_rank(df.select(y, *models), y, "_ry")
    for m in models:
        ranked = average_rank(ranked, m, f"_r_{m}")
    residuals = ranked.select(*((F.col(f"_r_{m}") - F.col("_ry")).alias(f"_e_{m}") for m in models))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = residuals.agg(*(safe_corr(f"_e_{a}", f"_e_{b}").alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def z_score(column: str, window) -> Column:
    return safe_divide(F.col(column) - F.avg(column).over(window), F.stddev_pop(column).over(window))


def ensemble(df: DataFrame, members: list[str], out: str) -> DataFrame:
    """The mean of the members' z-scores over all rows; the statistics are one broadcast row."""
    stats = df.agg(*(F.avg(m).alias(f"_m_{m}") for m in members), *(F.stddev_pop(m).alias(f"_s_{m}") for m in members))
    z = [safe_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_s_{m}")) for m in members]
    return df.join(F.broadcast(stats)).withColumn(out, sum(z[1:], z[0]) / len(members)).select(*df.columns, out)


def rank_residual(y: str, p: str, *by: str) -> Column:
    return group_rank(p, *by) - group_rank(y, *by)
