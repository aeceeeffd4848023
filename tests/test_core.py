"""Contracts, sources, undefined statistics and properties of the evaluation operators."""

import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymark.functions.columns import hash32, r6, safe_corr, tolerance
from tallymark.operators import contracts, encode, metrics, models, neighbours, ranks, replicates, report, resample, vectors
from tallymark.sources import files
from tallymark.streaming.running import windowed_errors


def test_many_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n int, k string")
    one = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    assert sorted(r.v for r in contracts.many_to_one(left, one, "k").collect()) == [10, 10, 20]
    for bad in (one.union(one.limit(1)), one.where("k = 'a'")):
        with pytest.raises(PySparkException):
            contracts.many_to_one(left, bad, "k").collect()
    assert contracts.many_to_one(left, one.where("k = 'a'"), "k", complete=False).count() == 2
    with pytest.raises(PySparkException):
        contracts.require(left, F.col("n") < 3, "n is too large").collect()
    assert contracts.alignment_mismatches(left, one, "k").count() == 0


def test_undefined_is_null(spark):
    flat = spark.createDataFrame([("g", 1.0, float(i)) for i in range(12)], "grp string, y double, p double")
    r = metrics.record(flat, "y", "p", "grp").first()
    assert r.spearman_pooled is None and r.spearman_within is None and r.groups_supported == 0 and r.rmse_log > 0
    two = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 1.0)], "grp string, y double, p double")
    assert ranks.spearman(two, "y", "p").first().rho is None
    assert metrics.auc(flat, F.col("y") > 0, "p").first().auc is None
    assert metrics.calibration(flat.withColumn("p", F.lit(1.0)), "y", "p").first().slope is None
    assert flat.groupBy("grp").agg(safe_corr("y", "p").alias("r")).first().r is None
    eleven = flat.limit(11)
    assert ranks.spearman_by(eleven, "p", "p", "grp", least=12).count() == 0


def test_rank_is_invariant_and_whole(spark):
    rows = spark.createDataFrame([(float((i * 37) % 50),) for i in range(200)], "x double")
    a = ranks.average_rank(rows, "x", "r").withColumn("z", F.exp(F.col("x") / 10))
    both = ranks.average_rank(a, "z", "s")
    assert both.where("r <> s").count() == 0
    assert both.agg(F.sum("r")).first()[0] == 200 * 201 / 2


def test_bootstrap_of_weight_one_is_the_point(spark):
    rows = spark.createDataFrame([(str(i), float(i % 7), float(i % 5)) for i in range(40)], "c string, y double, p double")
    ones = rows.select("c").distinct().withColumn("w", F.lit(replicates.pack(np.ones(1))))
    one = replicates.weighted_spearman(rows, ones, "c", "y", ["p"], 1).first().p
    assert abs(one - ranks.spearman(rows, "y", "p").first().rho) < 1e-9
    gate = resample.intervals(spark.createDataFrame([(1.0,)] * 18 + [(None,)] * 2, "v double"), {"v": F.col("v")}, 20, 0.95).first()
    assert gate.mean is None and gate.n_valid == 18


def test_conformal_is_monotone_and_caps_k(spark):
    rows = spark.createDataFrame([(float(i), float(i) + (i % 10) / 10) for i in range(50)], "y double, p double")
    got = {r.alpha: r for r in resample.conformal(rows, rows, "y", "p", [0.5, 0.1, 0.0001]).collect()}
    assert got[0.5].coverage <= got[0.1].coverage <= got[0.0001].coverage == 1.0
    assert abs(got[0.0001].q - 0.9) < 1e-9


def test_masked_pairs_are_brute_pairs(spark):
    rows = spark.createDataFrame([("".join("AC"[(i >> k) & 1] for k in range(9)),) for i in range(0, 512, 5)], "seq string")
    for d in (1, 2):
        assert sorted(map(tuple, neighbours.masked_pairs(rows, None, 9, d).collect())) == sorted(map(tuple, neighbours.brute_pairs(rows, None, 9, d).collect()))


def test_golden_probe(spark):
    train = spark.createDataFrame([("AAAAFEAAL", "train")], "seq string, split string")
    for planted, fired in (("CCAAFEAAL", 1), ("CCCAFEAAL", 0)):
        probe = train.union(spark.createDataFrame([(planted, "probe")], "seq string, split string"))
        assert neighbours.cross_split_violations(probe, 9, 2).count() == fired


def test_encodings(spark):
    rows = spark.createDataFrame([("k", "AXC")], "key string, text string")
    assert sorted(r["index"] for r in encode.positional_one_hot(rows, "key", "text").collect()) == [0, 41]
    with pytest.raises(ValueError):
        encode.blocks({}, ["none"], "key")
    table = files.matrix_table(spark, "  A C\nA 1 2\nC 2 3")
    assert [r.value for r in encode.table_encode(rows, "key", "text", table).orderBy("index").collect()] == [1.0, 2.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        files.matrix_table(spark, "  A C\nA 1 2\nC 0 3")


def test_tolerance_and_claims(spark):
    rows = spark.createDataFrame([("0.78",), ("0.780",), ("127",), ("0.7802",)], "q string")
    assert [r.t for r in rows.select(r6(tolerance(F.col("q"))).alias("t")).collect()] == [0.005, 0.005, 0.5, 0.0006]
    texts = spark.createDataFrame([("## Run 1\nalpha beta\n## Run 2",)], "text string")
    wanted = spark.createDataFrame([("beta",), ("gamma",)], "needle string")
    assert {r.needle: r.present for r in report.needles(texts, wanted).collect()} == {"beta": True, "gamma": False}
    assert report.heading_count(texts, r"## Run \d+").first().n == 2


def one_by_one(sizes, shares):
    """The split of each cluster, dealt in order to the split that lacks most."""
    want, have, out = np.array(shares) * sum(sizes), np.zeros(len(shares)), []
    for n in sizes:
        best = int(np.argmax((want - have) / np.maximum(want, 1e-9)))
        have[best] += n
        out.append(best)
    return out


def test_runs_of_equal_clusters_are_shared_as_one_by_one():
    rng = np.random.default_rng(2)
    for shares in ([0.8, 0.1, 0.1], [0.5, 0.5], [1.0], [0.7, 0.3, 0.0], [0.34, 0.33, 0.33]):
        for _ in range(30):
            sizes = sorted(rng.choice([1, 1, 1, 2, 3, 5, 40, 1000], rng.integers(1, 400)).tolist(), reverse=True)
            split = np.array(one_by_one(sizes, shares))
            runs = [(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)]
            got = models._shared_out(runs, np.array(shares) * sum(sizes))
            want = [(n, k, int(((np.array(sizes) == n) & (split == k)).sum())) for n, _ in runs for k in range(len(shares))]
            assert [(n, k, c) for n, k, _, c in got] == [w for w in want if w[2]]
    # A hundred million clusters of one size are as quick.
    assert sum(c for *_, c in models._shared_out([(3, 5), (1, 10**8)], np.array([0.8, 0.1, 0.1]) * (15 + 10**8))) == 10**8 + 5


def test_greedy_split_is_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(models, "_STEPS", 7)
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", int(n), str(i % 2) if i % 5 else None) for i, n in enumerate(rng.choice([1, 1, 2, 9, 60], 300))]
    names = ["train", "val", "test"]
    for stratum in (None, "s"):
        got = {r.cluster: r.split for r in models.greedy_split(spark.createDataFrame(rows, "cluster string, n int, s string"), {"train": 0.8, "val": 0.1, "test": 0.1}, 1, stratum).collect()}
        assert len(got) == len(rows)
        hashes = {r.cluster: r.h for r in spark.createDataFrame(rows, "cluster string, n int, s string").select("cluster", hash32("greedy", 1, F.col("cluster")).alias("h")).collect()}
        for own in ({None, "0", "1"},) if stratum is None else ({None}, {"0"}, {"1"}):
            ordered = sorted((r for r in rows if stratum is None or r[2] in own), key=lambda r: (-r[1], hashes[r[0]], r[0]))
            assert [got[r[0]] for r in ordered] == [names[k] for k in one_by_one([r[1] for r in ordered], [0.8, 0.1, 0.1])]


@pytest.mark.parametrize("rows_together", [5, 100_000])
def test_banded_neighbours_are_the_first(spark, monkeypatch, rows_together):
    """Against all pairs, within a set and across two that overlap."""
    monkeypatch.setattr(neighbours, "_BUCKET_ROWS", rows_together)
    rng = np.random.default_rng(6)
    words = lambda n: sorted({"".join(rng.choice(list("ABCé"), 6)) for _ in range(n)})
    one, two = words(160), words(120)
    two = sorted({*two, *one[:30]})
    df = lambda w: spark.createDataFrame([(x,) for x in [*w, w[0], None]], "seq string")
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))

    def brute(a, b):
        return {(x, y, d) for x in a for d in range(1, 5) for y in [y for y in b if apart(x, y) == d][:3]}

    got = {tuple(r) for r in neighbours.banded_neighbours(df(one), df(two), 6, 4, 3).collect()}
    assert got == brute(one, two)
    got = {tuple(r) for r in neighbours.banded_neighbours(df(one), None, 6, 4, 3).collect()}
    assert got == {(x, y, d) for x, y, d in brute(one, one) if x < y}
    assert neighbours.banded_neighbours(df(one).limit(0), None, 6, 4, 3).collect() == []


def test_greedy_split_keeps_clusters_and_quota(spark):
    groups = spark.createDataFrame([(f"c{i}", 1 + i % 5, i % 2) for i in range(200)], "cluster string, n long, s int")
    for stratum in (None, "s"):
        got = models.greedy_split(groups, {"train": 0.8, "val": 0.1, "test": 0.1}, 1, stratum).collect()
        total = sum(r.n for r in got)
        assert len(got) == len({r.cluster for r in got}) == 200
        assert all(abs(sum(r.n for r in got if r.split == s) / total - w) < 0.02 for s, w in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_best_epoch(spark):
    history = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.5, 0.4, 0.500001, 0.3, 0.2, 0.9])], "run string, epoch int, score double")
    got = models.best_epoch(history, "run", "epoch", "score", patience=4).first()
    assert (got.epoch, got.score) == (1, 0.5)


def test_min_distance(spark):
    a = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0), ("s", 1, 5.0, 0.0, 0.0)], "s string, i int, x double, y double, z double")
    b = spark.createDataFrame([("s", 7, 5.0, 3.0, 4.0)], "s string, j int, x double, y double, z double")
    assert vectors.min_distance(a, b, "s").first().d == 5.0
    with pytest.raises(ValueError):
        vectors.min_distance(a, b)
    with pytest.raises(ValueError):
        vectors.pair_l1(a, "i", "x")


def test_audits_of_all_pairs_are_bounded(spark):
    words = spark.createDataFrame([("AB",), ("AC",), ("BB",)], "seq string")
    assert neighbours.brute_pairs(words, None, 2, 1, most=3).count() == 2
    with pytest.raises(ValueError):
        neighbours.brute_pairs(words, None, 2, 1, most=2)
    with pytest.raises(ValueError):
        report.needles(words.withColumnRenamed("seq", "text"), words.withColumnRenamed("seq", "needle"), most=2)


def test_files(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    files.write_sorted_csv(rows, f"{root}/csv", "k")
    assert [tuple(r) for r in files.read_csv(spark, f"{root}/csv", "k string, v int").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(PySparkException):
        files.write_sorted_csv(rows, f"{root}/csv", "k")
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "p.json").write_text('{"y": [1.0, 2.0], "g": ["a", "b"]}')
    got = files.columns_to_rows(files.read_documents(spark, f"{root}/json"), [("y", "double"), ("g", "string")])
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(0, 1.0, "a"), (1, 2.0, "b")]
    (tmp_path / "json" / "p.json").write_text('{"y": [1.0], "g": ["a", "b"]}')
    with pytest.raises(PySparkException):
        files.columns_to_rows(files.read_documents(spark, f"{root}/json"), [("y", "double"), ("g", "string")]).collect()
    h = files.content_hashes(spark, f"{root}/json", "*.json").first().sha256
    files.require_hash(spark, f"{root}/json/p.json", h)
    with pytest.raises(ValueError):
        files.require_hash(spark, f"{root}/json/p.json", "0")
    files.claim_once(spark, f"{root}/guard", {"read": 1})
    with pytest.raises(PySparkException):
        files.claim_once(spark, f"{root}/guard", {"read": 2})
    assert files.write_verified(rows, f"{root}/pq").count() == 2
    for _ in range(2):
        files.write_unit(rows, f"{root}/units", "unit", "one")
    files.write_unit(rows, f"{root}/units", "unit", "two")
    assert spark.read.parquet(f"{root}/units").count() == 4
    files.write_documents(rows, f"{root}/docs", "k", "v")
    assert "sequence: b" in files.job_documents(rows.limit(1), {"A": "k"}).first().yaml


def test_streaming_errors(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10, 5)
    rows = spark.createDataFrame([(t, "g", 1.0, 2.0), (t, "g", 1.0, 0.0)], "ts timestamp, grp string, y double, p double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_errors(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "y", "p", "grp")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("errors").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("errors").first()
    assert (got.n, got.rmse, got.mae) == (2, 1.0, 1.0)


def test_order_kit(spark):
    from tallymark.operators.order import numbered, running

    rows = spark.createDataFrame([((i * 37) % 101, i % 7) for i in range(500)], "x int, w int").withColumn("id", F.monotonically_increasing_id())
    got = numbered(rows, ["x", "id"]).orderBy("_i").collect()
    assert [r._i for r in got] == list(range(500)) and [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)
    total = 0
    for r in running(rows, ["x", "id"], {"before": F.col("w")}).orderBy("x", "id").collect():
        assert r.before == total
        total += r.w
    assert numbered(rows.limit(0), ["x"]).count() == 0


def test_no_task_sees_all_rows(spark, sf):
    """Windows over all rows run over a range's totals only."""
    from tallymark.operators import order
    from tallymark.plans.catalogue import QUERIES

    rows = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.col("id").alias("k"))
    for df in (ranks.average_rank(rows, "x", "r"), order.numbered(rows, ["k"]), ranks.value_gaps(rows, "x"), resample.hashed_subset(rows, "k", 0.3, "t", 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        single = [line for line in plan.splitlines() if "SinglePartition" in line]
        assert len(single) <= 2, plan  # the ranges' totals, and a count
    assert QUERIES["shuffle_global"](spark, sf).count() == 1


def test_keys_and_banks(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "g string, n int, s string")
    one, two = spark.createDataFrame([("a", 5), ("b", 6)], "g string, v int"), spark.createDataFrame([("x", 7)], "s string, u int")
    with pytest.raises(PySparkException):
        contracts.chained(left, (one, "g"), (two, "s")).collect()
    assert contracts.chained(left.where("n = 1"), (one, "g"), (two, "s")).first().u == 7
    dup = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "k string, o int, v double")
    assert {(r.k, r.v) for r in contracts.keep_first(dup, ["k"], ["o"]).collect()} == {("a", 2.0), ("b", 3.0)}
    assert [r.k for r in contracts.concat_dedup_head([dup, dup], ["k"], ["o"], 1).collect()] == ["a"]
    bank = contracts.bank(dup.where("o > 1"), "k", "v")
    assert sorted((r["index"], r.k) for r in bank.collect()) == [(0, "a"), (1, "b")]
    with pytest.raises(PySparkException):
        contracts.gather(spark.createDataFrame([("c",)], "k string"), bank, "k").collect()


def test_audits_stop(spark):
    from tallymark.operators import audits

    null = spark.createDataFrame([(0.2,)], "rho double")
    assert audits.null_gate(null, "rho", 0.3).first().rho == 0.2
    with pytest.raises(PySparkException):
        audits.null_gate(null, "rho", 0.08).collect()
    table = audits.audit([("a", null, 0, 1), ("b", null, 0, 0.1), ("c", null.where("rho > 1").agg(F.max("rho")), 0, 1)])
    assert {(r.check, r.ok) for r in table.collect()} == {("a", True), ("b", False), ("c", False), ("all", False)}
    with pytest.raises(ValueError, match="b, c"):
        audits.require_audit(table)
    audits.require_audit(table.where("check = 'a'"))


def test_mantel_blocks_equal_the_plan(spark, sf):
    from tallymark.plans import catalogue

    own = catalogue._structures(spark, sf).where("structure < 4")
    blocks = {r.structure: r for r in resample.mantel_blocks(own, "structure", "vec_id", "embedding", 32, 199, catalogue.SEED).collect()}
    plan = {r.structure: r for r in catalogue.mantel(spark, sf).collect() if r.structure < 4}
    assert set(blocks) == set(plan)
    for s, r in plan.items():
        assert abs(blocks[s].r - r.r) < 1e-5 and abs(blocks[s].p - r.p) < 1e-9 and abs(blocks[s].noise - r.noise) < 1e-5


def test_mlp_learns(spark):
    rows = [("g", "AC"[i % 2] + "DE"[i // 2 % 2] + "FG"[i // 4 % 2], float(i % 2) + 0.5 * (i // 2 % 2)) for i in range(400)]
    table = spark.createDataFrame(rows, "grp string, s string, y double")
    kind = dict(hidden=(16, 8), rounds=25, patience=25)
    scored = models.mlp_predictions(table, table.distinct(), table.distinct(), "grp", "s", "y", "ACDEFG", 3, [1, 2], **kind).collect()
    ordered = [r.y for r in sorted(scored, key=lambda r: r.pred)]
    assert len(scored) == 8 and ordered == sorted(ordered)  # all levels are told apart


def test_segments_and_pca(spark):
    import random

    import numpy as np

    from tallymark.functions.columns import hamming

    rng = random.Random(4)
    texts = ["".join(rng.choice("AB") for _ in range(12)) for _ in range(60)]
    table = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {(r.a, r.b, r.d) for r in neighbours.segment_pairs(table, "s", 12, 3).collect()}
    want = {(a, b, d) for a in texts for b in texts if a < b and (d := sum(x != y for x, y in zip(a, b, strict=True))) <= 3}
    assert got == want and spark.range(1).select(hamming(F.lit("AB"), F.lit("AA"), 2)).first()[0] == 1
    x = np.random.default_rng(1).normal(size=(50, 4)) * [1, 2, 3, 4]
    cells = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    share = [r.retained for r in vectors.pca_variance(cells, list("abcd")).orderBy("component").collect()]
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(share, values / values.sum())


def test_documents_are_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "n": 1\n}\n')
    assert [(r.file, r.json) for r in files.read_documents(spark, f"file://{tmp_path}").collect()] == [("a.json", '{\n "n": 1\n}\n')]


def test_manifest_and_structures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    files.write_manifest(rows, f"file://{tmp_path}/m", {"model": "x"})
    assert files.require_manifest(rows, f"file://{tmp_path}/m", {"model": "x", "more": "y"}).count() == 2
    for df, now in ((rows, {"model": "z"}), (rows.limit(1), {"model": "x"}), (rows.withColumn("s", F.lit("c")), {"model": "x"})):
        with pytest.raises(ValueError):
            files.require_manifest(df, f"file://{tmp_path}/m", now)
    heads = ["group_PDB", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"]
    text = "data_t\nloop_\n" + "".join(f"_atom_site.{h}\n" for h in heads) + "ATOM N N GLY A 1 1.0 2.0 3.0\nATOM H H GLY A 1 0 0 0\nATOM C \"C1'\" ALA B 2 4 5 6.5\n#\nloop_\n_other.x\nATOM\n"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.cif").write_text(text)
    got = sorted(files.read_atoms(spark, f"file://{tmp_path}/s").collect(), key=lambda r: r.chain)
    assert [(r.file, r.chain, r.residue, r.name, r.atom, r.z) for r in got] == [("one.cif", "A", 1, "GLY", "N", 3.0), ("one.cif", "B", 2, "ALA", "C1'", 6.5)]


def test_residuals_seeds_and_skill(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(f"g{i % 3}", i, float((i * 7) % 36), float(i)) for i in range(36)], "grp string, k int, y double, p double")
    assert rows.select("k", metrics.rank_residual("y", "p").alias("e")).agg(F.sum("e")).first()[0] == 0
    z = rows.select(metrics.z_score("y", Window.partitionBy("grp")).alias("z"))
    assert abs(z.agg(F.sum("z")).first()[0]) < 1e-9
    seeds = rows.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(3)))).withColumn("p", F.col("p") + F.col("seed"))
    mean, long = models.seed_ensemble(seeds, ["k"], "p", "seed")
    assert {(r.k, r.p) for r in mean.collect()} == {(i, i + 2.0) for i in range(36)} and long.count() == 72
    assert metrics.skill_vs_support(rows, "y", "p", "grp").first().groups == 3
