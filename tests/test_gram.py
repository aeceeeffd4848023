"""Gram fits, components, variances without pairs and the ledger, against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import gram, vectors
from tallymark.sources import files


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 5)) * [1, 10, 0.1, 1, 1] + [1e6, 0, 3, 0, 0]
    x[:, 4] = 2.5  # doesn't vary
    y = x[:, 1] * 0.3 - x[:, 2] * 4 + rng.normal(size=600)
    return x, y, rng.choice(["train", "val", "test"], 600, p=[0.6, 0.2, 0.2])


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, a.tolist(), float(b), str(c)) for i, (a, b, c) in enumerate(zip(*data, strict=True))]
    rows += [(9001, None, 1.0, "train"), (9002, [0.0] * 5, None, "train"), (9003, [0.0] * 5, 1.0, None)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, split string").repartition(5)


def plain_ridge(x, y, penalty, scaled):
    """By centring the rows themselves."""
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    vary = deviation > 1e-9
    z = (x - mean)[:, vary] / (deviation[vary] if scaled else 1.0)
    w = np.zeros(x.shape[1])
    w[vary] = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(vary.sum()), z.T @ (y - y.mean()) / len(z)) / (deviation[vary] if scaled else 1.0)
    return w, y.mean() - mean @ w


def test_sweep(table, data):
    x, y, split = data
    sets = {"some": [0, 2], "all": [0, 1, 2, 3, 4]}
    got = gram.sweep(table, F.col("x"), F.col("y"), F.col("split"), sets, [0.0001, 1.0]).collect()
    assert len(got) == 8 and sum(r.chosen for r in got) == 1
    error = lambda part, own, w, c: np.sqrt(np.mean((x[split == part][:, own] @ w + c - y[split == part]) ** 2))
    for r in got:
        own = sets[r.features]
        w, c = plain_ridge(x[split == "train"][:, own], y[split == "train"], r.penalty, r.scaling == "scaled")
        assert abs(r.val_rmse - error("val", own, w, c)) < 1e-6
        assert r.chosen == (r.val_rmse == min(q.val_rmse for q in got))
        assert r.test_rmse is None if not r.chosen else abs(r.test_rmse - error("test", own, w, c)) < 1e-6
    assert gram.sweep(table.limit(0), F.col("x"), F.col("y"), F.col("split"), sets, [1.0]).collect() == []


def test_rows_are_read_as_arrays(spark, table, data):
    """Products of the rows' flat buffers; arrays of other lengths are an error."""
    x, y, split = data
    found = gram.grams(table, F.col("x"), F.col("y"), F.col("split"))
    for part in ("train", "val", "test"):
        own = np.column_stack([x, y])[split == part] - found[part].origin
        own = np.column_stack([own, np.ones(len(own))])
        assert np.allclose(found[part].products, own.T @ own)
    uneven = spark.createDataFrame([([1.0, 2.0], 1.0, "a"), ([1.0], 1.0, "a"), ([1.0, 2.0, 3.0], 1.0, "a")], "x array<double>, y double, split string").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        gram.grams(uneven, F.col("x"), F.col("y"), F.col("split"))


def test_components(table, data):
    x = data[0][:, [1, 2, 3, 4]]
    vector = F.slice("x", 2, 4)
    found = gram.principal(table.where("id < 9000"), vector, 3)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    values, directions = values[::-1][:3], directions.T[::-1][:3]
    directions = directions * np.sign(directions[np.arange(3), np.abs(directions).argmax(axis=1)])[:, None]
    assert np.allclose(found.directions, directions, atol=1e-6) and np.allclose(found.retained, values / np.trace(np.cov(x.T, bias=True)))
    rows = {r.id: r.p for r in gram.projected(table.select("id", "x"), found, vector, "p").collect()}
    assert rows[9001] is None and len(rows) == 603
    assert np.allclose([rows[i] for i in range(600)], (x - x.mean(axis=0)) @ directions.T, atol=1e-6)
    assert gram.principal(table.limit(0), vector, 3) is None


def test_sample_variance(spark):
    rng = np.random.default_rng(3)
    rows = [(e, s, k, float(rng.integers(0, 6) if k else 1.5)) for e in range(40) for s in (0, 1) for k in range(3) if rng.random() < 0.9] + [(99, 0, 7, 2.0), (99, 1, 7, None)]
    got = {r.k: r for r in vectors.sample_variance(spark.createDataFrame(rows, "e long, s int, k int, v double"), "e", "s", "k", "v").collect()}
    for k in (0, 1, 2, 7):
        at = {(e, s): v for e, s, c, v in rows if c == k and v is not None}
        own = [abs(v - at[e, 1]) for (e, s), v in at.items() if s == 0 and (e, 1) in at]
        first = [v for (_, s), v in at.items() if s == 0]
        pairs = [abs(a - b) for i, a in enumerate(first) for b in first[:i]]
        assert (got[k].within is None) if not own else abs(got[k].within - np.mean(own)) < 1e-9
        assert (got[k].across is None) if not pairs else abs(got[k].across - np.mean(pairs)) < 1e-9


def test_units_go_on_where_a_run_stopped(spark, tmp_path):
    df = spark.createDataFrame([(f"0{i % 7}", i) for i in range(70)] + [(None, 1)], "unit string, v int")
    path, log = f"file://{tmp_path}/out", []

    def work(fail_from):
        def run(rows):
            names = sorted(r.unit for r in rows.select("unit").distinct().collect())
            log.append(names)
            if names[0] >= fail_from:
                raise RuntimeError("stopped")
            return rows.where("v % 10 < 9").groupBy("unit").agg(F.sum("v").alias("total"))

        return run

    with pytest.raises(RuntimeError):
        files.run_units(df, path, "unit", work("04"), together=2)
    assert sorted(r.unit for r in files.finished_units(spark, path).collect()) == ["00", "01", "02", "03"]
    assert files.run_units(df, path, "unit", work("99"), together=2) == 3
    assert log == [["00", "01"], ["02", "03"], ["04", "05"], ["04", "05"], ["06"]]
    assert files.run_units(df, path, "unit", work("99")) == 0 and len(log) == 5
    out = {r._unit: r.total for r in spark.read.schema("total long, _unit string").parquet(f"{path}/results").collect()}
    assert out == {f"0{i}": sum(v for v in range(i, 70, 7) if v % 10 < 9) for i in range(7)}
