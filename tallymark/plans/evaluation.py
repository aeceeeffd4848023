"""More of the catalogue: guards, foils, sweeps, ablations and plain scalar reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import safe_corr, uniform
from ..operators import audits, contracts, metrics, models, neighbours, order, ranks, vectors
from .catalogue import SEED, _corr, _greedy_sql, _hash, _rank, _rounded, _val, query
from .views import groups, pairs, preds, strings, table


@query(""", k AS (SELECT split, seq9, count(DISTINCT grp) AS k FROM preds GROUP BY split, seq9), m AS (SELECT avg(k) FILTER (split = 'test') AS a, avg(k) FILTER (split <> 'test') AS b FROM k)
SELECT round(a, 6) AS inside, round(b, 6) AS outside, round(a / b, 6) AS ratio, a / b BETWEEN 0.85 AND 1.15 AS ok FROM m""")
def representativeness(spark, sf):
    return _rounded(audits.representativeness(preds(spark, sf), "seq9", "grp"))


@query(f""", h AS (SELECT *, {_hash("'foil|' || grp || '|' || seq9")} / 4294967296.0 < 0.1 AS held FROM pairs), t AS (SELECT DISTINCT seq9 FROM h WHERE NOT held)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN t.seq9 IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM h LEFT JOIN t USING (seq9) WHERE held""")
def row_split_leak(spark, sf):
    rows = audits.row_split(pairs(spark, sf), ["grp", "seq9"], 0.1)
    return _rounded(contracts.seen_share(rows.where("held"), rows.where("NOT held"), "seq9"))


@query(f""", tr AS (SELECT * FROM train WHERE {_hash("'hold|' || grp")} / 4294967296.0 >= 0.05), g AS (SELECT grp, avg(yl) AS m, stddev_samp(yl) AS s FROM tr GROUP BY grp), a AS (SELECT avg(yl) AS m, stddev_samp(yl) AS s FROM tr)
SELECT v.grp, v.seq9, round((yl - CASE WHEN g.s IS NULL THEN a.m ELSE g.m END) / coalesce(nullif(CASE WHEN g.s IS NULL THEN a.s ELSE g.s END, 0), 1), 6) AS z FROM val v CROSS JOIN a LEFT JOIN g USING (grp)""")
def group_z_scores(spark, sf):
    rows = preds(spark, sf)
    train = rows.where("split = 'train'").where(uniform("hold", F.col("grp")) >= 0.05)
    return _rounded(audits.group_z_score(train, rows.where("split = 'val'"), "grp", "yl").select("grp", "seq9", "z"))


@query(""", m AS (SELECT avg(pa) AS a, avg(pb) AS b FROM val), f AS (SELECT CAST(unnest([0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS factor),
e AS (SELECT 'pa' AS model, factor, a + factor * (pa - a) AS p, yl FROM val, m, f UNION ALL SELECT 'pb', factor, b + factor * (pb - b), yl FROM val, m, f),
t AS (SELECT model, factor, sqrt(avg((p - yl) * (p - yl))) AS rmse FROM e GROUP BY model, factor)
SELECT model, factor, round(rmse, 6) AS rmse, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9), factor) = 1 AS chosen FROM t""")
def sweep_selection(spark, sf):
    return _rounded(audits.sweep(_val(spark, sf), "yl", ["pa", "pb"], [0.25, 0.5, 0.75, 1.0]))


@query(f""", i AS (SELECT unnest(range(1, 10)) AS p), e AS (SELECT p, substr(seq9, p, 1) AS c, avg(yl) AS e FROM train, i GROUP BY ALL),
v AS (SELECT grp, seq9, yl, i.p, coalesce(e.e, 0) AS e FROM val CROSS JOIN i LEFT JOIN e ON e.p = i.p AND e.c = substr(seq9, i.p, 1)), w AS (SELECT *, sum(e) OVER (PARTITION BY grp, seq9) AS f FROM v),
r AS (SELECT p, yl, f, f - e AS g FROM w), q AS (SELECT p, {_corr("f", "yl")} AS f, {_corr("g", "yl")} AS g FROM r GROUP BY p)
SELECT CAST(p - 1 AS BIGINT) AS position, round(f, 6) AS "full", round(g, 6) AS ablated, round(f - g, 6) AS fall FROM q""")
def position_ablation(spark, sf):
    rows = preds(spark, sf)
    return _rounded(audits.position_ablation(rows.where("split = 'train'"), rows.where("split = 'val'"), ["grp", "seq9"], "seq9", "yl", 9))


@query(f""", r AS (SELECT split, yl, pa, {_rank("yl", "split")} AS ry, {_rank("pa", "split")} AS rp FROM preds WHERE split <> 'train'),
m AS (SELECT split, {_corr("ry", "rp")} AS rho, sqrt(avg((pa - yl) * (pa - yl))) AS rmse FROM r GROUP BY split)
SELECT round(v.rho, 6) AS val_rho, round(t.rho, 6) AS test_rho, round(t.rho - v.rho, 6) AS rho_change, round(v.rmse, 6) AS val_rmse, round(t.rmse, 6) AS test_rmse, round(t.rmse - v.rmse, 6) AS rmse_change FROM m v, m t WHERE v.split = 'val' AND t.split = 'test'""")
def test_change(spark, sf):
    rows = preds(spark, sf)
    rmse = F.sqrt(F.avg(F.pow(F.col("pa") - F.col("yl"), 2)))
    one = {}
    for part in ("val", "test"):
        own = rows.where(F.col("split") == part)
        one[part] = ranks.spearman(own, "yl", "pa").select(F.col("rho").alias(f"{part}_rho")).join(own.agg(rmse.alias(f"{part}_rmse")))
    both = one["val"].join(one["test"])
    return _rounded(both.withColumn("rho_change", F.col("test_rho") - F.col("val_rho")).withColumn("rmse_change", F.col("test_rmse") - F.col("val_rmse")))


@query(f""", r AS (SELECT grp, {_rank("yl", "grp")} AS gy, {_rank("pb", "grp")} AS gp FROM val), t AS (SELECT grp, CAST(count(*) AS BIGINT) AS n, round({_corr("gy", "gp")}, 6) AS rho FROM r GROUP BY grp HAVING count(*) >= 12),
o AS (SELECT *, row_number() OVER (ORDER BY rho DESC, grp) AS a, row_number() OVER (ORDER BY rho, grp) AS b FROM t WHERE rho IS NOT NULL)
SELECT grp, n, rho, 'top' AS side FROM o WHERE a <= 5 UNION ALL SELECT grp, n, rho, 'bottom' FROM o WHERE b <= 5""")
def skill_extremes(spark, sf):
    skill = _rounded(ranks.spearman_by(_val(spark, sf), "yl", "pb", "grp", least=metrics.MIN_ROWS))
    return audits.extremes(skill, "rho", "grp", 5)


@query(f"""SELECT split, round(min(yl), 6) AS low, round(quantile_cont(yl, 0.25), 6) AS q1, round(quantile_cont(yl, 0.75), 6) AS q3, round(max(yl), 6) AS high, round(max(yl) - min(yl), 6) AS width FROM preds GROUP BY split""")
def value_ranges(spark, sf):
    rows = preds(spark, sf).select("split", "yl")
    own = rows.groupBy("split").agg(F.min("yl").alias("low"), F.max("yl").alias("high")).join(order.quantiles(rows, "yl", [0.25, 0.75], ("split",)), "split")
    return _rounded(own.select("split", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "high", (F.col("high") - F.col("low")).alias("width")))


@query(f""", s AS (SELECT grp, seq9, yl FROM preds WHERE split <> 'train'), o AS (SELECT grp, seq9 FROM s WHERE {_hash("'drop|' || grp || '|' || seq9")} / 4294967296.0 >= 0.02)
SELECT s.grp, s.seq9, 'a' AS side FROM s ANTI JOIN o USING (grp, seq9)""")
def prediction_mismatches(spark, sf):
    rows = preds(spark, sf).where("split <> 'train'").select("grp", "seq9")
    kept = rows.where(uniform("drop", F.col("grp"), F.col("seq9")) >= 0.02)
    return contracts.alignment_mismatches(rows, kept, "grp", "seq9")


@query(f""", g AS (SELECT * FROM groups_ WHERE {_hash("'known|' || grp")} / 4294967296.0 >= 0.1)
SELECT g.grp IS NOT NULL AS matched, CAST(count(*) AS BIGINT) AS n, round(avg(yl), 6) AS mean_yl FROM preds p LEFT JOIN g USING (grp) GROUP BY 1""")
def flagged_left_join(spark, sf):
    known = groups(spark, sf).where(uniform("known", F.col("grp")) >= 0.1)
    rows = contracts.left_with_flag(preds(spark, sf).select("grp", "yl"), known, "grp")
    return _rounded(rows.groupBy("matched").agg(F.count("*").alias("n"), F.avg("yl").alias("mean_yl")))


@query(""", t AS (SELECT * FROM train), x AS (SELECT grp, arg_max(seq9, (yl, seq9)) AS best, max(yl) AS high, arg_min(seq9, (yl, seq9)) AS worst, min(yl) AS low FROM t GROUP BY grp) SELECT grp, best, round(high, 6) AS high, worst, round(low, 6) AS low FROM x""")
def group_extremes(spark, sf):
    by = F.struct("yl", "seq9")
    rows = preds(spark, sf).where("split = 'train'")
    return _rounded(rows.groupBy("grp").agg(F.max_by("seq9", by).alias("best"), F.max("yl").alias("high"), F.min_by("seq9", by).alias("worst"), F.min("yl").alias("low")))


@query("""WITH a AS (SELECT vec_id // 16 AS s, vec_id % 16 AS m, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings WHERE len(embedding) >= 3)
SELECT CAST(p.s AS BIGINT) AS structure, CAST(p.m % 4 AS BIGINT) AS i, CAST(q.m % 4 AS BIGINT) AS j, round(min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))), 6) AS d FROM a p JOIN a q USING (s) WHERE p.m < 8 AND q.m >= 8 GROUP BY ALL""", views=False)
def atom_distances(spark, sf):
    v = F.col("embedding").cast("array<double>")
    atoms = table(spark, sf, "embeddings").where(F.size("embedding") >= 3).select(F.floor(F.col("vec_id") / 16).alias("structure"), (F.col("vec_id") % 16).alias("m"), *(v[k].alias(c) for k, c in enumerate("xyz")))
    left = atoms.where("m < 8").select("structure", (F.col("m") % 4).alias("i"), "x", "y", "z")
    right = atoms.where("m >= 8").select("structure", (F.col("m") % 4).alias("j"), "x", "y", "z")
    return _rounded(vectors.min_distance(left, right, "structure"))


_HISTORY = "m AS (SELECT o_orderpriority AS run, year(o_orderdate) * 12 + month(o_orderdate) AS t, round(avg(o_totalprice), 2) AS s FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL), h AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY t) AS e, s FROM m)"


@query(f"""WITH RECURSIVE {_HISTORY},
f AS (SELECT run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS epoch, CAST('-inf' AS DOUBLE) AS best, 0 AS stale FROM h GROUP BY run
  UNION ALL SELECT f.run, f.k + 1, CASE WHEN h.s > best + 1e-5 THEN h.e ELSE epoch END, CASE WHEN h.s > best + 1e-5 THEN CAST(h.s AS DOUBLE) ELSE best END, CASE WHEN h.s > best + 1e-5 THEN 0 ELSE stale + 1 END FROM f JOIN h ON h.run = f.run AND h.e = f.k + 1 WHERE stale < 6)
SELECT run, CAST(arg_max(epoch, k) AS BIGINT) AS epoch, arg_max(best, k) AS score FROM f GROUP BY run""", views=False)
def early_stopping(spark, sf):
    """The recorded scores are the months' mean prices of each priority; six months without a better one stop a run."""
    rows = table(spark, sf, "orders").where("o_orderpriority is not null and o_orderdate is not null")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    scores = rows.groupBy(F.col("o_orderpriority").alias("run"), month.alias("t")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    history = order.numbered(scores, ["t"], "i", ("run",)).select("run", (F.col("i") + 1).cast("int").alias("epoch"), "score")
    return _rounded(models.best_epoch(history, "run", "epoch", "score", patience=6))


@query(f""", r AS (SELECT yl, pa, pb, {_rank("yl")} AS ry, {_rank("pa")} AS ra, {_rank("pb")} AS rb FROM val), m AS (SELECT {_corr("ra", "ry")} AS a, {_corr("rb", "ry")} AS b FROM r)
SELECT round(a, 6) AS rho_a, round(b, 6) AS rho_b, round(a - b, 6) AS gain, CASE WHEN a - 0.05 - b <= 0 AND a + 0.05 - b >= 0 THEN 'spans zero' WHEN abs(a - b) <= 0.01 THEN 'within seed noise' ELSE 'survives' END AS verdict FROM m""")
def gain_verdict(spark, sf):
    rows = _val(spark, sf)
    both = ranks.spearman(rows, "pa", "yl").select(F.col("rho").alias("rho_a")).join(ranks.spearman(rows, "pb", "yl").select(F.col("rho").alias("rho_b")))
    gain = F.col("rho_a") - F.col("rho_b")
    return _rounded(both.select("rho_a", "rho_b", gain.alias("gain"), audits.verdict(gain, gain - 0.05, gain + 0.05, 0.01).alias("verdict")))


@query(""", g AS (SELECT seq, CAST('0x' || substr(md5('stratum|' || seq), 1, 8) AS BIGINT) % 4 AS s FROM strings) SELECT CAST(s AS BIGINT) AS stratum, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY s""")
def strata_sizes(spark, sf):
    from ..functions.columns import hash32

    return _rounded(strings(spark, sf).groupBy((hash32("stratum", F.col("seq")) % 4).alias("stratum")).agg(F.count("*").alias("n")))


@query(_greedy_sql("CASE WHEN n > 20 THEN 'large' ELSE 'small' END"))
def greedy_split_stratified(spark, sf):
    rows = pairs(spark, sf)
    roots = neighbours.clusters(rows.select(F.col("seq9").alias("seq")), 9, 2)
    sizes = rows.join(roots.withColumnRenamed("seq", "seq9"), "seq9").groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("n"))
    return models.greedy_split(sizes.withColumn("stratum", F.when(F.col("n") > 20, "large").otherwise("small")), {"train": 0.8, "val": 0.1, "test": 0.1}, SEED, "stratum")


@query(f""", q AS (SELECT CAST(p.i AS DOUBLE) AS weight, {_corr("z", "yl")} AS r FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS i) p, LATERAL (SELECT yl, (1 - p.i) * pb + p.i * pa AS z FROM val) GROUP BY p.i)
SELECT weight, round(r, 6) AS r FROM q""")
def blend_curve(spark, sf):
    weights = [0.0, 0.25, 0.5, 0.75, 1.0]
    each = _val(spark, sf).select("yl", F.explode(F.array(*(F.struct(F.lit(w).alias("weight"), ((1 - w) * F.col("pb") + w * F.col("pa")).alias("z")) for w in weights))).alias("g")).select("yl", "g.*")
    return _rounded(each.groupBy("weight").agg(safe_corr("z", "yl").alias("r")))
