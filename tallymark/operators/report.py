"""Cost tables and an audit of quoted numbers against recorded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tolerance


def cost_benefit(runs: DataFrame, rates: DataFrame, scores: DataFrame, floor: str) -> DataFrame:
    """(label, device, seconds, cost, gain, cost_per_point): gain over the floor model, cost of a hundredth of it.

    ``runs``: (label, device, seconds); ``rates``: (device, rate); ``scores``: (label, rho).
    A run without a score or a gain that is not positive has no cost per point.
    """
    base = scores.where(F.col("label") == floor).select(F.col("rho").alias("_floor"))
    cost = F.col("seconds") * F.col("rate")
    gain = F.col("rho") - F.col("_floor")
    joined = runs.join(F.broadcast(rates), "device").join(scores, "label", "left").join(F.broadcast(base))
    return joined.select("label", "device", "seconds", cost.alias("cost"), gain.alias("gain"), F.when(gain > 0, cost / (gain * 100)).alias("cost_per_point"))


def cost_totals(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: total cost, and seconds on and off accelerators."""
    rows = runs.join(F.broadcast(rates), "device")
    on = F.col("device") != "cpu"
    return rows.agg(F.sum(F.col("seconds") * F.col("rate")).alias("cost"), F.sum(F.when(on, F.col("seconds")).otherwise(0.0)).alias("gpu_s"), F.sum(F.when(on, 0.0).otherwise(F.col("seconds"))).alias("cpu_s"))


def claims_audit(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """(claim, path, quoted, found, verdict): ok, mismatch or missing.

    ``claims``: (claim, file, path, quoted) with JSON paths such as ``$['a.b'][0].c``;
    ``documents``: (file, json).  Quoted numbers are strings, so that their decimals count.
    """
    paths = claims.join(documents, "file", "left")
    found = F.expr("get_json_object(json, path)").cast("double")
    rows = paths.withColumn("found", found)
    verdict = F.when(F.col("found").isNull(), "missing").when(F.abs(F.col("found") - F.col("quoted").cast("double")) <= tolerance(F.col("quoted")) + 1e-12, "ok").otherwise("mismatch")
    return rows.select("claim", "path", "quoted", "found", verdict.alias("verdict"))


def needles(texts: DataFrame, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """(needle, present): whether any text holds each needle verbatim.

    Every text is searched for every needle, so these are broadcast, and more than ``most`` are an error.
    """
    if (n := wanted.select("needle").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} needles: {n}")
    hits = texts.join(F.broadcast(wanted), F.contains(F.col("text"), F.col("needle"))).select("needle").distinct().withColumn("present", F.lit(True))
    return wanted.select("needle").distinct().join(hits, "needle", "left").select("needle", F.coalesce("present", F.lit(False)).alias("present"))


def heading_count(texts: DataFrame, pattern: str) -> DataFrame:
    """One row: how many matches of ``pattern`` the texts hold."""
    return texts.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("n"))
