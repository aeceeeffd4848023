"""Networks fitted over shards, against plain fits in one process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import training

MODELS = [training.MeanPool(3, 2, (5,)), training.Attention(3, 2, (5, 4)), training.OneHot(7, (6, 4))]


def inputs(model, rng, n):
    return model.inputs((rng.integers(-1, 7, (n, 3)) if isinstance(model, training.OneHot) else rng.normal(size=(n, 6))).tolist())


@pytest.mark.parametrize("model", MODELS)
def test_gradients(model):
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    x, y = inputs(model, rng, 20), rng.normal(size=20)
    params = [p + rng.normal(0, 0.1, p.shape) for p in model.start(rng)]
    loss = lambda: ((model.predict(params, x) - y) ** 2).mean() / 2
    for p, g in zip(params, model.gradient(params, x, y), strict=True):
        assert p.shape == g.shape
        for i in rng.choice(p.size, min(p.size, 6), replace=False):
            at = np.unravel_index(i, p.shape)
            p[at] += 1e-6
            up = loss()
            p[at] -= 2e-6
            down = loss()
            p[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


@pytest.mark.parametrize("few", [0, 12, 128])
def test_one_hot_pass_is_sparse_adam(monkeypatch, few):
    """Against plain steps that move the rows a batch names: letters, groups that recur in a batch, names in several columns, unknown ones."""
    monkeypatch.setattr(training, "FEW", few)
    rng = np.random.default_rng(4)
    n, model = 150, training.OneHot(60, (6, 4))
    apart = np.stack([rng.integers(0, 5, n), 5 + rng.integers(0, 5, n), np.where(rng.random(n) < 0.4, 20, 10 + rng.integers(-11, 50, n))], axis=1)
    for x in (apart, apart % 9, apart[:, :1], np.where(apart == 3, -1, apart), np.full((n, 2), -1)):
        x, y = model.inputs(x), rng.normal(size=n)
        start = model.start(rng)
        got = training.one_pass(model, start, x, y, 16, 0.01, np.random.default_rng(5))
        params, m, v = [p.copy() for p in start], [np.zeros_like(p) for p in start], [np.zeros_like(p) for p in start]
        order = np.random.default_rng(5).permutation(n)
        for t in range(1, 11):
            pick = order[16 * t - 16 : 16 * t]
            moved = [np.setdiff1d(x[pick], [model.count])] + [slice(None)] * (len(params) - 1)
            for p, g, a, b, rows in zip(params, model.gradient(params, x[pick], y[pick]), m, v, moved, strict=True):
                a[rows], b[rows] = 0.9 * a[rows] + 0.1 * g[rows], 0.999 * b[rows] + 0.001 * g[rows] ** 2
                p[rows] -= 0.01 * (a[rows] / (1 - 0.9**t)) / (np.sqrt(b[rows] / (1 - 0.999**t)) + 1e-8)
        assert all(np.allclose(p, q, atol=2e-4) for p, q in zip(got, params, strict=True))


def test_packed_rows_are_the_rows(monkeypatch):
    """A shard's rows, several in one, over batches, shards and both parts; a ragged row is an error."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x, y, shard = rng.integers(-1, 200, (500, 3)), rng.normal(size=500), np.sort(rng.integers(0, 4, 500))
    held = np.concatenate([np.sort(rng.random((shard == k).sum()) < 0.3) for k in range(4)])
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(held[s]), pa.array(x[s].tolist(), pa.list_(pa.int32())), pa.array(y[s])], names=["shard", "held", "x", "y"])
    monkeypatch.setattr(training, "_PACKED_BYTES", 100)
    kind = np.dtype("<i2")
    packed = list(training._pack([batch(slice(a, a + 130)) for a in range(0, 520, 130)], kind))
    assert sum(map(len, packed)) < 100
    packed = [b.slice(a, 7) for b in packed for a in range(0, len(b), 7)]
    for k, (number, own, target, out) in enumerate(training._shards(packed, kind)):
        s = shard == k
        assert number == k and (own == x[s]).all() and (target == y[s]).all() and (out == held[s]).all()
    assert k == 3
    ragged = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([True, True]), pa.array([[1], [2, 3]], pa.list_(pa.int32())), pa.array([1.0, 2.0])], names=["shard", "held", "x", "y"])
    with pytest.raises(ValueError):
        list(training._pack([ragged], kind))


def test_mlp_baseline_computes_its_view_once(spark, sf, monkeypatch):
    from tallymark.plans import catalogue

    class Stop(Exception):
        pass

    def seen(*frames_and_rest, **_):
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames_and_rest[:3]]
        assert not any("Aggregate" in p for p in plans), plans
        raise Stop

    monkeypatch.setattr(catalogue.models, "mlp_predictions", seen)
    with pytest.raises(Stop):
        catalogue.mlp_baseline(spark, sf)


def vectors(spark, n):
    """A target that only attention can read: the first number of the vector whose second number is largest."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3, 2))
    y = x[np.arange(n), x[:, :, 1].argmax(axis=1), 0] * 2 + 1
    rows = [(r.reshape(-1).tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0), ([0.0] * 6, None)]
    return spark.createDataFrame(rows, "x array<double>, y double").withColumn("held", F.pmod(F.xxhash64("x"), F.lit(5)) == 0)


def test_one_shard_is_a_plain_fit(spark):
    model, df = training.Attention(3, 2, (5,)), vectors(spark, 300)
    train, held = df.where("not held"), df.where("held")
    got = training.fit(train, held, model, F.col("x"), "y", [3], rounds=4, patience=4)[0]
    order = lambda d: d.where("x is not null and y is not null").orderBy(F.xxhash64("x", "y"), "y").collect()
    x, y = np.array([r.x for r in order(train)]).reshape(-1, 3, 2), np.array([r.y for r in order(train)])
    hx, hy = np.array([r.x for r in order(held)]).reshape(-1, 3, 2), np.array([r.y for r in order(held)])
    params = model.start(np.random.default_rng(3))
    params[-1] += y.mean()
    best = np.inf
    for number in range(1, 5):
        params = training.one_pass(model, params, x, y, 256, 0.01 / number**0.5, np.random.default_rng([3, number, 0]))
        if (error := ((model.predict(params, hx) - hy) ** 2).mean()) < best:
            best, kept = error, [p.copy() for p in params]
    assert all(np.allclose(a, b) for a, b in zip(got, kept, strict=True))


def test_shards_learn_as_one(spark, monkeypatch):
    """Nine shards come as far as one, and attention further than the mean."""
    df = vectors(spark, 2_700)
    train, held = df.where("not held"), df.where("held")

    def error(model, rows):
        monkeypatch.setattr(training, "SHARD_ROWS", rows)
        fitted = training.fit(train, held, model, F.col("x"), "y", [1], rounds=12, patience=12, batch=32, rate=0.02)
        return training.predicted(held, fitted, model, F.col("x")).agg(F.avg(F.pow(F.col("pred") - F.col("y"), 2))).first()[0]

    spread = held.agg(F.var_pop("y")).first()[0]
    one, nine, mean = error(training.Attention(3, 2, (16,)), 50_000), error(training.Attention(3, 2, (16,)), 250), error(training.MeanPool(3, 2, (16,)), 250)
    assert one < 0.5 * spread and nine < 0.65 * spread and nine < mean
    unknown = training.predicted(df.where("x is null"), [training.MeanPool(3, 2, (4,)).start(np.random.default_rng(0))], training.MeanPool(3, 2, (4,)), F.col("x"))
    assert [r.pred for r in unknown.collect()] == [None]


def test_nothing_to_fit(spark):
    df = vectors(spark, 10).limit(0)
    with pytest.raises(ValueError):
        training.fit(df, df, training.MeanPool(3, 2, (4,)), F.col("x"), "y", [1])
