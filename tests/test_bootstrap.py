"""The bootstraps of 2,000 draws against numpy."""

import hashlib

import numpy as np
import pytest

from tallymark.operators import replicates
from tallymark.plans import catalogue


def spearman(x, y):
    def rank(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    a, b = rank(x), rank(y)
    return np.corrcoef(a, b)[0, 1] if a.min() < a.max() and b.min() < b.max() else np.nan


def brute(rows, reps):
    """(pooled, within): a row a replicate, of pa and pb."""
    names = sorted({r.seq9 for r in rows})
    grp, values = np.array([r.grp for r in rows]), np.array([(r.yl, r.pa, r.pb) for r in rows])
    place = np.searchsorted(names, [r.seq9 for r in rows])
    pooled, within = [], []
    for rep in range(reps):
        picks = [int(hashlib.md5(f"boot|{catalogue.SEED}|{rep}|{i}".encode()).hexdigest()[:8], 16) % len(names) for i in range(len(names))]
        drawn = np.repeat(np.arange(len(rows)), np.bincount(picks, minlength=len(names))[place])
        v, g = values[drawn], grp[drawn]
        pooled.append([spearman(v[:, 0], v[:, k]) for k in (1, 2)])
        own = [v[g == x] for x in np.unique(g)]
        each = np.array([[spearman(w[:, 0], w[:, k]) for k in (1, 2)] for w in own if len(w) >= 12])
        within.append(np.nanmean(each, axis=0) if len(each) else [np.nan, np.nan])
    return np.array(pooled), np.array(within)


def test_full_bootstraps(spark, sf):
    pooled, within = brute(catalogue._val(spark, sf).collect(), 2_000)
    want = {"cluster_bootstrap_ci_full": {"pa": pooled[:, 0], "pb": pooled[:, 1]}, "paired_bootstrap_ci_full": {"pb-pa": pooled[:, 1] - pooled[:, 0]}, "within_bootstrap_ci_full": {"pb-pa": within[:, 1] - within[:, 0], "pb": within[:, 1]}}
    for name, metrics in want.items():
        got = {r.metric: r for r in catalogue.QUERIES[name](spark, sf).collect()}
        assert set(got) == set(metrics) and name not in catalogue.ORACLE
        for metric, v in metrics.items():
            v, r = v[~np.isnan(v)], got[metric]
            assert r.n_valid == len(v) and len(v) >= 0.95 * 2_000
            assert np.allclose([r.mean, r.lo, r.hi], [v.mean(), *np.percentile(v, [2.5, 97.5])], atol=2e-5)


@pytest.mark.parametrize("grp", [None, "grp"])
def test_ways_agree(spark, grp, monkeypatch):
    """Whole groups and tables of a target's values give what ranges of rows give, with ties, cut blocks, nulls and a constant group."""
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(150)}", f"g{k % 4}" if k % 9 else None, 1.5 if k % 4 == 3 else float(rng.integers(12)), float(rng.integers(40)) if k % 3 else float(rng.random()), None if k == 7 else float(rng.random())) for k in range(900)]
    df = spark.createDataFrame(rows, "c string, grp string, y double, a double, b double")
    found = lambda: {r.rep: (r.a, r.b) for r in replicates.bootstrap_spearman(df, "c", "y", ["a", "b"], 70, 3, grp).collect()}
    monkeypatch.setattr(replicates, "BLOCK", 16)
    got = found()
    calls, plain = [], replicates._by_ranges
    monkeypatch.setattr(replicates, "_by_ranges", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(replicates, "VALUES", 0)
    monkeypatch.setattr(replicates, "GROUP_ROWS", 150)
    want = found()
    assert calls and len(got) == 70 and set(got) == set(want)
    assert all(np.allclose(got[rep], want[rep], atol=1e-12) for rep in got)


def test_draws_are_arrays(spark):
    """Every cluster's draws of every replicate, and none twice; no row a draw is made."""
    df = spark.createDataFrame([(f"c{i:04d}",) for i in range(1_100)], "c string")
    drawn = replicates.packed_draws(df, "c", 95, 10, 7)
    assert "explode" not in drawn._jdf.queryExecution().toString().lower()
    got = {r.c: replicates.unpack(bytes(r.w)) for r in drawn.collect()}
    want = np.zeros((1_100, 10), int)
    for k in range(10):
        for i in range(1_100):
            want[int(hashlib.md5(f"boot|7|{95 + k}|{i}".encode()).hexdigest()[:8], 16) % 1_100, k] += 1
    assert all((got.get(f"c{i:04d}", np.zeros(10)) == want[i]).all() for i in range(1_100))
