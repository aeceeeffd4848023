"""Orders of groups of any size: ranks, quantiles and replicates against numpy, with groups and ties cut over ranges."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.operators import order, ranks, replicates


def average_ranks(v):
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


@pytest.fixture(scope="module")
def rows(spark):
    """One group with most rows and one value with many, null groups and values, and a group of one row."""
    g = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") == 999, F.lit("one")).otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")))
    x = F.when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise((F.hash("id") % 500).cast("double"))
    return spark.range(4000).select("id", g.alias("g"), x.alias("x"), (F.hash("id", F.lit(1)) % 40).cast("double").alias("y"))


def test_running_in_groups(rows):
    w = Window.partitionBy("g").orderBy("id")
    want = rows.select("id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    got = order.running(rows, ["id"], {"i": F.lit(1).cast("long")}, ("g",), whole=True).select("id", "i", F.col("i_all").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_group_is_split(spark):
    one = spark.range(20_000).select(F.lit("g").alias("g"), F.hash("id").alias("x"))
    parts = [r["count"] for r in order.ranged(one, ["g", "x"]).groupBy("_part").count().collect()]
    assert len(parts) == 8 and max(parts) < 0.3 * sum(parts)


def test_no_window_over_a_group(rows):
    """Every window of ranks and quantiles is over a range's rows or over one row a range."""
    for df in (ranks.spearman_by(rows, "x", "y", "g"), order.quantiles(rows, "x", [0.5], ("g",))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("_part" in line.split("], [")[1] or "_t_" in line for line in windows), windows


def test_ranks_and_spearman(rows):
    got = {r.g: r for r in ranks.spearman_by(rows, "x", "y", "g", least=1).collect()}
    seen = rows.collect()
    for g in {r.g for r in seen}:
        own = np.array([(r.x, r.y) for r in seen if r.g == g and r.x is not None])
        assert got[g].n == len(own)
        if len(own) >= 3:
            assert abs(got[g].rho - np.corrcoef(average_ranks(own[:, 0]), average_ranks(own[:, 1]))[0, 1]) < 1e-9
        else:
            assert got[g].rho is None


def test_quantiles(rows, spark):
    shares = [0.0, 0.025, 0.25, 0.5, 1 / 3, 0.975, 1.0]
    got = {r.g: r.q for r in order.quantiles(rows, "x", shares, ("g",)).collect()}
    seen = rows.where("x is not null").collect()
    groups = {r.g for r in seen}
    assert set(got) == groups
    for g in groups:
        assert np.allclose(got[g], np.quantile([r.x for r in seen if r.g == g], shares))
    assert np.allclose(order.quantiles(rows, "x", shares).first().q, np.quantile([r.x for r in seen], shares))
    empty = spark.createDataFrame([], "x double, g string")
    assert [r.q for r in order.quantiles(empty, "x", [0.5]).collect()] == [None]
    assert order.quantiles(empty, "x", [0.5], ("g",)).collect() == []


@pytest.mark.parametrize("grp", [None, "g"])
def test_replicates(spark, grp):
    """Weighted ranks with hot ties and groups that lie in several ranges, and replicates that leave sides constant."""
    rng, reps = np.random.default_rng(8), 17
    n = 900
    g = np.where(np.arange(n) % 10 < 6, "hot", np.char.add("g", (np.arange(n) % 4).astype(str)))
    y = np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 60, n).astype(float))
    p = np.where(rng.random(n) < 0.5, y, rng.normal(size=n).round(2))
    c = rng.integers(0, 120, n)
    w = rng.poisson(1.0, (120, reps))
    w[:, 3] = 0
    w[5, 3] = 1
    rows = spark.createDataFrame([(int(a), str(b), float(d), float(e), 2.0) for a, b, d, e in zip(c, g, y, p, strict=True)], "c long, g string, y double, p double, flat double")
    weights = spark.createDataFrame([(k, bytearray(replicates.pack(w[k]))) for k in range(120)], "c long, w binary")
    got = {r.rep: r for r in replicates.weighted_spearman(rows, weights, "c", "y", ["p", "flat"], reps, grp).collect()}
    assert sorted(got) == list(range(reps))
    for rep in range(reps):
        drawn = np.repeat(np.arange(n), w[c, rep])
        each = []
        for one in np.unique(g[drawn]) if grp else ["all"]:
            own = drawn[g[drawn] == one] if grp else drawn
            a, b = average_ranks(y[own]), average_ranks(p[own])
            if len(own) >= (12 if grp else 3) and a.min() < a.max() and b.min() < b.max():
                each.append(np.corrcoef(a, b)[0, 1])
        assert got[rep].flat is None
        assert got[rep].p is None if not each else abs(got[rep].p - np.mean(each)) < 1e-9


def test_replicates_in_turns(spark, monkeypatch):
    """Turns of replicates are the same draws."""
    rows = spark.createDataFrame([(f"c{i % 30}", float(i % 17), float(i * i % 23)) for i in range(200)], "c string, y double, p double")
    whole = {r.rep: r.p for r in replicates.bootstrap_spearman(rows, "c", "y", ["p"], 11, 3).collect()}
    monkeypatch.setattr(replicates, "EDGE_BYTES", 4 * 4 * 8 * 8)
    turns = {r.rep: r.p for r in replicates.bootstrap_spearman(rows, "c", "y", ["p"], 11, 3).collect()}
    assert whole == turns and sorted(whole) == list(range(11))
