"""Tables on which only larger copies used to fail: shared names, repeated rows, ties of formatting."""

import duckdb
import pytest
from compare import differences
from pyspark.errors import PySparkException

from tallymark.operators import contracts
from tallymark.plans import catalogue, evaluation, extended  # noqa: F401 (registers their queries)


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """A few suppliers past 10,000, whose names of four characters are those of others."""
    root = tmp_path_factory.mktemp("shared")
    with duckdb.connect() as c:
        c.execute("CREATE TABLE keys AS SELECT unnest([7, 1000, 1001, 10000, 10001, 10011, 10012]) AS k")
        c.execute(f"COPY (SELECT k AS s_suppkey FROM keys) TO '{root}/supplier.parquet'")
        lines = "SELECT k AS l_suppkey, p AS l_partkey, CAST(10 + (k * 7 + p * 3) % 40 AS DOUBLE) AS l_quantity FROM keys, range(40) t(p)"
        c.execute(f"COPY ({lines} UNION ALL SELECT NULL, 3, 20.0) TO '{root}/lineitem.parquet'")
    return str(root)


def same_as_sql(spark, sf, name):
    with duckdb.connect() as con:
        for t in ("supplier", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return differences(spark, con, sf, name, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", ["checked_join", "chained_join"])
def test_shared_names_join_all_their_partners(spark, shared, name):
    assert not same_as_sql(spark, shared, name)


def test_partners_come_together(spark):
    """A name's rows are one run of the output, and so are a row's partners, so that what is written of them is small."""
    from itertools import groupby

    left = spark.createDataFrame([(f"k{n % 7}", n) for n in range(140)], "k string, n int").repartition(5)
    right = spark.createDataFrame([(f"k{m % 7}", m) for m in range(35)], "k string, m int")
    got = contracts.with_partners(left, right, "k").collect()
    assert len(got) == 140 * 5
    assert len([k for k, _ in groupby(got, lambda r: r.k)]) == 7
    assert len([n for n, _ in groupby(got, lambda r: r.n)]) == 140


def test_chained_join_multiplies_last(spark, shared):
    """Names, which have many partners, are the last join: no row is shuffled after it."""
    plan = extended.chained_join(spark, shared)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert "[grp#" in joins[0] and "[seq9#" in joins[1], plan
    assert "Exchange" not in plan[: plan.index(joins[0])]


def test_a_lost_row_is_still_an_error(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("a", 5), ("a", 6), ("b", 7)], "k string, v int")
    assert sorted((r.n, r.v) for r in contracts.with_partners(left, right, "k").collect()) == [(1, 5), (1, 6), (2, 7)]
    with pytest.raises(PySparkException):
        contracts.with_partners(left, right.where("k = 'a'"), "k").collect()


def test_mantel_by_arrays_is_the_plan(spark):
    """Whole structures, and ones with a short, a null and a repeated vector, against the plan a row a pair and replicate."""
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from tallymark.operators import resample, vectors

    names = np.array([f"mantel|7|{r}|{i}".encode() for r in (1, 99, 12345) for i in (0, 7, 123456789, 10**18)])
    assert resample.md5_heads(names).tolist() == [int(hashlib.md5(n).hexdigest()[:8], 16) for n in names.tolist()]
    rng = np.random.default_rng(3)
    rows = [(i // 6, i, [float(v) for v in rng.normal(size=8).round(2)]) for i in range(31)]
    rows[7], rows[13] = (1, 7, rows[7][2][:5]), (2, 13, None)
    table = spark.createDataFrame([*rows, (3, 18, rows[18][2])], "structure long, id long, x array<double>")
    for some in (table, table.where("structure = 0 or structure >= 4")):
        got = {(r.structure, r.part): r for r in resample.mantel_parts(some, "structure", "id", "x", 8, [(0, 4), (4, 8)], 49, 7).collect()}
        g = vectors.pair_l1(some, "id", "x", None, ("structure",)).select("structure", "a", "b", F.round("dist", 9).alias("g"))
        t = [vectors.pair_l1(some, "id", "x", F.floor(F.col("k") / 4) == k, ("structure",)).select("structure", "a", "b", F.round("dist", 9).alias("t"), F.lit(k).alias("part")) for k in (0, 1)]
        want = {(r.structure, r.part): r for r in resample.mantel(g.join(t[0].union(t[1]), ["structure", "a", "b"]), 49, 7, ("structure", "part")).collect()}
        assert set(got) == set(want) and len(want) > 1
        for k, r in want.items():
            assert abs(got[k].r - r.r) < 1e-9 and abs(got[k].p - r.p) < 1e-9 and abs(got[k].noise - r.noise) < 1e-9


def test_column_mapping_of_shared_names(spark, shared):
    """No broadcast of exploded cells, and shared names as in SQL."""
    from tallymark.operators import neighbours

    assert not same_as_sql(spark, shared, "pseudoseq_mapping")
    one = spark.createDataFrame([("a", "XY"), ("b", "ZY")], "g string, s string")
    two = spark.createDataFrame([("a", "YXQY"), ("b", "QZYY")], "g string, t string")
    found = neighbours.column_mapping(one, two, "g", "s", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1), (1, 3, 1)]
    assert plan.count("BroadcastExchange") <= 1, plan  # the number of rows


def test_brute_pairs_of_any_size(spark, monkeypatch):
    """In several parts and units, within one set and across two, against plain loops; more than 100,000 strings are no error."""
    import numpy as np

    from tallymark.operators import neighbours

    rng = np.random.default_rng(5)
    words = lambda n, m: sorted({"".join(rng.choice(list("ACDEFé"), m)) for _ in range(n)})
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    df = lambda w: spark.createDataFrame([(x,) for x in [*w, w[0], None]], "seq string")
    for length, d in ((6, 2), (40, 27)):
        one, two = words(300, length), words(200, length)
        two = sorted({*two, *one[:20]})
        for size in (40, 65_536):
            monkeypatch.setattr(neighbours, "_PART_STRINGS", size)
            got = sorted(map(tuple, neighbours.brute_pairs(df(one), None, length, d).collect()))
            assert got == sorted((x, y, apart(x, y)) for x in one for y in one if x < y and apart(x, y) <= d)
            got = sorted(map(tuple, neighbours.brute_pairs(df(one), df(two), length, d).collect()))
            assert got == sorted((x, y, apart(x, y)) for x in one for y in two if apart(x, y) <= d)
    many = spark.range(100_001).selectExpr("lpad(cast(id as string), 6, '0') AS seq")
    monkeypatch.undo()
    assert neighbours.brute_pairs(many, None, 6, 0).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 9, 20])
def test_all_pairs_by_bitmaps(monkeypatch, length):
    """Every pair is compared, 64 by an operation: against loops, for any distance, in one piece and in several."""
    import numpy as np

    from tallymark.operators import neighbours

    rng = np.random.default_rng(1)
    for distance in (0, 1, 2, 3, length + 1):
        for n, m, letters in ((1, 1, 1), (50, 70, 3), (33, 64, 2), (70, 129, 5), (0, 5, 2), (5, 0, 2)):
            x, y = rng.integers(0, letters, (n, length)), rng.integers(0, letters, (m, length))
            x = x[np.lexsort(x.T[::-1])]
            apart = (x[:, None, :] != y[None, :, :]).sum(axis=2)
            want = sorted((i, j, apart[i, j]) for i, j in zip(*np.nonzero(apart <= distance), strict=True))
            for size in (64, 64 << 20):
                monkeypatch.setattr(neighbours, "_BITMAP_BYTES", size)
                assert sorted(t for found in neighbours._all_pairs(x, y, letters, distance) for t in zip(*found, strict=True)) == want


def test_formatting_is_that_of_printf(spark):
    """Half-way decimals go by the exact binary value, as in the SQL."""
    from pyspark.sql import functions as F

    from tallymark.functions.columns import or_na

    values = [0.0625, 0.1235, 0.2345, -0.0015, 0.5005, 0.12349951, 0.0, -0.0000001, 1.0, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in table.select("i", or_na(F.col("v"), 3, 6).alias("t")).orderBy("i").collect()]
    with duckdb.connect() as con:
        want = [con.execute("SELECT CASE WHEN $1 IS NULL THEN 'n/a' ELSE printf('%.3f', round(CAST($1 AS DOUBLE), 6)) END", [v]).fetchall()[0][0] for v in values]
    assert got == want


def test_equal_rows_add_up_in_feature_sets(spark, tmp_path):
    """Two parts with one string, under one name: one row with its scores added up, as in the SQL."""
    from tallymark.plans.views import preds

    with duckdb.connect() as c:
        # Suppliers 1000 and 10000 share a name and measure the same.
        c.execute(f"COPY (SELECT unnest([1000, 10000, 3]) AS s_suppkey) TO '{tmp_path}/supplier.parquet'")
        c.execute(f"COPY (SELECT s AS l_suppkey, p AS l_partkey, CAST(10 + p * 7 % 30 AS DOUBLE) AS l_quantity FROM (SELECT unnest([1000, 10000]) AS s), range(40) t(p) UNION ALL SELECT 3, p, CAST(12 + p % 5 AS DOUBLE) FROM range(200) t(p)) TO '{tmp_path}/lineitem.parquet'")
    assert preds(spark, str(tmp_path)).groupBy("grp", "seq9", "yl").count().where("count > 1").count() > 0
    # Which row's n SQL's any_value takes is open, so only the correlations are compared.
    with duckdb.connect() as con:
        for t in ("supplier", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = {r[0]: r[1] for r in con.execute('SELECT "set", r FROM (' + catalogue.ORACLE["feature_set_comparison"] + ")").fetchall()}
    got = {r.set: r.r for r in catalogue.QUERIES["feature_set_comparison"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_touched_rows_are_the_gradient():
    """A batch's gradient of the rows it names is the whole gradient; a pass leaves the other rows."""
    import numpy as np

    from tallymark.operators import training

    rng, model = np.random.default_rng(4), training.OneHot(50, (6, 4))
    x, y, params = model.inputs(rng.integers(-1, 9, (40, 3))), rng.normal(size=40), model.start(rng)
    rows, g, rest = model.touched(params, x, y)
    whole = model.gradient(params, x, y)
    own = np.zeros((50, 6))
    own[rows] = g
    assert np.allclose(own, whole[0]) and all(np.allclose(a, b) for a, b in zip(rest, whole[1:], strict=True))
    after = training.one_pass(model, params, x, y, 8, 0.01, rng)
    assert (after[0][9:] == params[0][9:]).all() and (after[0][rows] != params[0][rows]).any(axis=1).all()


def test_rmse_replicates_are_of_cluster_sums(spark):
    """A cluster's rows are added up before they meet the draws, with the same result."""
    from tallymark.operators import resample

    table = spark.createDataFrame([(f"c{i % 9}", float(i % 7), float(i % 5), None if i == 3 else float(i % 4)) for i in range(80)], "c string, y double, a double, b double")
    picks = resample.draws(table, "c", 20, 7)
    got = {r.rep: (r.a, r.b) for r in resample.replicate_rmse(table, picks, "c", "y", ["a", "b"]).collect()}
    whole = {r.rep: (r.a, r.b) for r in resample.replicate_metric(table.where("b is not null"), picks, "c", "y", ["a", "b"], resample.weighted_rmse).collect()}
    assert set(got) == set(whole) and all(abs(got[k][1] - whole[k][1]) < 1e-9 for k in whole)
    assert all(a > 0 for a, _ in got.values())


def test_a_string_goes_to_few_blocks(spark):
    """Every mask is in one block that sees its places; nine rows a string are shuffled, not one a mask."""
    from itertools import combinations

    from tallymark.operators import neighbours

    for length, furthest, blocks in ((9, 5, 9), (6, 4, 15), (4, 3, 4), (5, 1, 3)):
        plan = neighbours.mask_plan(length, furthest)
        masks = [m for _, own in plan for m in own]
        assert sorted(masks) == sorted(m for d in range(1, furthest + 1) for m in combinations(range(length), d))
        assert all(not set(places) & set(m) for places, own in plan for m in own) and len(plan) <= blocks


def test_clusters_by_blocks(spark):
    """Single-linkage clusters against plain loops; a few rows a string are shuffled."""
    import numpy as np

    from tallymark.operators import neighbours

    rng = np.random.default_rng(8)
    words = lambda n: sorted({"".join(rng.choice(list("ACDé"), 6)) for _ in range(n)})
    df = lambda w: spark.createDataFrame([(x,) for x in [*w, w[0], None]], "seq string")
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    some = words(120)
    for d in (1, 2):
        root = {x: x for x in some}
        while True:
            new = {x: min(root[y] for y in some if apart(x, y) <= d) for x in some}
            if new == root:
                break
            root = new
        got = {r.seq: r.root for r in neighbours.clusters(df(some).where("seq is not null"), 6, d).collect()}
        assert got == root
    plan = neighbours.star_edges(df(some), 6, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(array(concat(") == 1 and "*" not in plan.split("Generate explode(array(")[1].split("]")[0]
