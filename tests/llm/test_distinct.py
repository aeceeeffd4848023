"""Bitmap sketches against a plain implementation and exact sets."""

import datetime as dt
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import distinct
from tallymark.llm import queries as Q

PARTS = ("union", "both", "only_a")
CLICKS = "click_id long, ts timestamp, client_id long, kind string, day string, key string, register int, bits long"


def sketch(keys):
    """Registers' bitmaps as a list of sets of bits."""
    out = [set() for _ in range(1024)]
    for key in keys:
        h = int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16)
        rest, k = h >> 10, 0
        while k < 49 and not rest >> k & 1:
            k += 1
        out[h % 1024].add(k)
    return out


def likeliest(registers):
    """The cardinality by a plain search for the likelihood's root."""
    if not any(registers):
        return 0.0
    counts = [sum(k in r for r in registers) for k in range(50)]
    rates = [2.0 ** -(min(k, 48) + 1) / 1024 for k in range(50)]
    low, high = 1e-3, 1e9
    for _ in range(200):
        n = math.sqrt(low * high)
        up = sum(r * (c / -math.expm1(-n * r) - 1024) for c, r in zip(counts, rates, strict=True)) > 0
        low, high = (n, high) if up else (low, n)
    return n


def brute(rows):
    """(day, kind_a, kind_b): exact and estimated numbers, window by window."""
    used = [((ts.date() - dt.date(1970, 1, 1)).days, kind, key) for ts, key, kind in rows if ts is not None and key is not None and kind is not None]
    days, kinds = sorted({d for d, _, _ in used}), sorted({k for _, k, _ in used})
    window = lambda kind, last: {key for d, k, key in used if k == kind and last - 13 <= d <= last}
    a = {(k, d): window(k, d) for k in kinds for d in days}
    b = {(k, d): window(k, d - 7) for k in kinds for d in days}
    out = {}
    for d in days:
        for x in kinds:
            for y in kinds:
                p, q = a[x, d], b[y, d]
                sp, sq = sketch(p), sketch(q)
                na, nb, nu = likeliest(sp), likeliest(sq), likeliest([u | v for u, v in zip(sp, sq, strict=True)])
                nu = min(max(na, nb, nu), na + nb)
                out[d, x, y] = (len(p | q), len(p & q), len(p - q)), (nu, max(na + nb - nu, 0), max(nu - nb, 0))
    return out


def check(got, rows):
    want = brute(rows)
    assert {(r.day, r.kind_a, r.kind_b) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        exact, estimated = want[r.day, r.kind_a, r.kind_b]
        assert tuple(r[f"n_{p}"] for p in PARTS) == exact
        assert all(abs(r[f"est_{p}"] - e) <= 2e-3 + 1e-6 * e for p, e in zip(PARTS, estimated, strict=True))
        assert all(0 <= r[f"err_{p}"] <= 8 * r.est_union / 32 + 3 + 1e-3 for p in PARTS)
    for p in PARTS:
        assert sum(abs(r[f"est_{p}"] - r[f"n_{p}"]) <= r[f"err_{p}"] for r in got) >= 0.9 * len(got)


def odd_clicks(spark, rows):
    df = spark.createDataFrame([(i, ts, key, kind) for i, (ts, key, kind) in enumerate(rows)], "click_id long, ts timestamp, client_id long, kind string")
    return df.repartition(3).select("*", *(F.lit("clash").alias(c) for c in ("day", "key", "register", "bits", "kind_a", "n_a", "run")))


def test_windows(spark):
    at = lambda day, hour=5: dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)
    rng = np.random.default_rng(3)
    rows = [(at(int(d)), int(c), str(k)) for d, c, k in zip(rng.integers(0, 40, 1500), rng.integers(0, 300, 1500), rng.choice(["a", "b", "c"], 1500), strict=True)]
    rows += [(at(200), 7, "late"), (at(200), 7, "late"), (at(200, 23), -8, "late"), (None, 7, "a"), (at(3), None, "a"), (at(3), 7, None), (at(900), 2**60, "a")]
    # One key with a third of all rows.
    rows += [(at(d % 40), 99, "a") for d in range(800)]
    check(distinct.window_algebra(odd_clicks(spark, rows), "kind", "ts", "client_id").collect(), rows)


def test_empty(spark):
    got = distinct.window_algebra(odd_clicks(spark, []).limit(0), "kind", "ts", "client_id")
    assert got.collect() == [] and len(got.columns) == 12


def test_query(spark, sf):
    rows = [(r.ts, r.client_id, r.kind) for r in spark.read.parquet(f"{sf}/clicks.parquet").collect()]
    check(Q.op11_distinct(spark, sf).collect(), rows)


def test_errors_by_simulation():
    """Over many hashes the errors' standard deviation is what the information says, at small and large sizes."""
    rng = np.random.default_rng(5)

    def counts(keys):
        bits = np.zeros((1024, 50), bool)
        bits[keys[0], keys[1]] = True
        return bits

    for only_a, both, only_b in ((30, 20, 10), (800, 400, 3000), (20_000, 15_000, 500)):
        n = only_a + both + only_b
        found = []
        for _ in range(150):
            keys = np.array([rng.integers(0, 1024, n), np.minimum(rng.geometric(0.5, n) - 1, 49)])
            a, b = counts(keys[:, : only_a + both]), counts(keys[:, only_a:])
            found.append(distinct.algebra(*(x.sum(axis=0)[None, :].astype(float) for x in (a, b, a | b))))
        for part, true in (("union", n), ("both", both), ("only_a", only_a)):
            est = np.array([f[f"est_{part}"][0] for f in found])
            stated = np.mean([(f[f"err_{part}"][0] - 0.5) / distinct.WIDTH for f in found])
            assert abs(est.mean() - true) < 0.01 * n + 1
            assert 0.75 * est.std() < stated + 0.1 and stated < 1.4 * est.std() + 0.3


def test_nothing_whole_is_broadcast(spark, sf):
    """Keys, runs and sketches meet by merges; only days, which the calendar bounds, are broadcast."""
    rows = spark.read.parquet(f"{sf}/clicks.parquet")
    keys = distinct.daily_keys(rows, "kind", "ts", "client_id")
    plan = distinct.window_sketches(keys, 14, [0, 7])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1
