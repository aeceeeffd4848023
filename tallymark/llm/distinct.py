"""Set algebra of distinct counts by probabilistic counting bitmaps (PCSA).

A key's hash picks one of 1,024 registers and, with probability 2**-(k+1), bit k of its
64-bit bitmap; a sketch is the registers' bitmaps, and sketches merge by OR.  For n keys a
bit of rate r is set with probability 1 - exp(-n r), so how many registers have bit k,
for each k, is all that the maximum-likelihood cardinality needs.  Intersections and
differences follow by inclusion and exclusion; the Fisher information of the bits, and the
covariances of overlapping sketches' bits, give their errors.

Rows are first made distinct by (set, step, key),
combined before the shuffle, so a key with a third of all rows sends one row a set and step
and task.  Sketches are rows of (set, step, register): nothing that grows with the input
goes through one task, the driver or a broadcast.

Defined cases: rows with a null set, time or key take no part; repeated rows count once;
a set without rows in a window is empty, with estimates and errors of an empty sketch; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

REGISTERS, BITS = 1024, 50
#: Standard errors that an interval reaches to each side; windows of one table share their keys and so their luck.
WIDTH = 3.0
#: The bits' rates: how likely one key sets bit k of one register; the last bit takes what is left.
RATES = [2.0 ** -(k + 1) / REGISTERS for k in range(BITS - 1)] + [2.0 ** -(BITS - 1) / REGISTERS]
_HALVINGS = 80


def register_and_bit(key: Column) -> tuple[Column, Column]:
    """The register (from 0) and the bitmap of one set bit of a key; 60 bits of its MD5."""
    h = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    rest = F.shiftright(h, 10).bitwiseOR(F.lit(1 << (BITS - 1)))
    return h.bitwiseAND(F.lit(REGISTERS - 1)).cast("int"), rest.bitwiseAND(-rest)


def daily_keys(rows: DataFrame, kind: str, time: str, key: str) -> DataFrame:
    """Distinct (kind, day, key); ``day`` counts from 1970-01-01."""
    day = F.unix_date(F.col(time).cast("date")).cast("long")
    return rows.select(F.col(kind).alias("kind"), day.alias("day"), F.col(key).alias("key")).where("kind is not null and day is not null and key is not null").distinct()


def sketches(keys: DataFrame, *by: str) -> DataFrame:
    """(by, register, bits): a bitmap a register that holds any of the keys."""
    register, bit = register_and_bit(F.col("key"))
    return keys.select(*by, register.alias("register"), bit.alias("bit")).groupBy(*by, "register").agg(F.bit_or("bit").alias("bits"))


def occupancy(sets: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """For each group of registers, ``<column>_c``: how many registers have each bit."""
    def counts(c: str) -> Column:
        bits = F.coalesce(F.col(c), F.lit(0).cast("long"))
        return F.array(*(F.sum(F.shiftright(bits, k).bitwiseAND(F.lit(1).cast("long"))) for k in range(BITS))).alias(f"{c}_c")

    return sets.groupBy(*by).agg(*map(counts, columns))


def cardinality(counts: np.ndarray) -> np.ndarray:
    """For each row of bit counts the n of the largest likelihood, found by halving its logarithm; 0 if no bit is set."""
    rates, low, high = np.array(RATES), np.full(len(counts), -2.8), np.full(len(counts), 35.0)
    for _ in range(_HALVINGS):
        mid = (low + high) / 2
        # The derivative: set bits pull n up, unset ones down.
        up = (rates * (counts / -np.expm1(-np.exp(mid)[:, None] * rates) - REGISTERS)).sum(axis=1) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(counts.any(axis=1), np.exp((low + high) / 2), 0.0)


def _information(n: np.ndarray) -> np.ndarray:
    """Fisher information of all bits about each ``n``; 1 for none."""
    rates, n = np.array(RATES), np.where(n > 0, n, 1.0)[:, None]
    return (rates**2 * REGISTERS * np.exp(-n * rates) / -np.expm1(-n * rates)).sum(axis=1)


def _covariance(a: np.ndarray, b: np.ndarray, union: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Covariance of the estimates of two sets of ``a`` and ``b`` keys with so many in their union and in common.

    The bits' model has Poisson numbers of keys; the part that comes from those numbers is taken off.
    """
    rates, some = np.array(RATES), (a > 0) & (b > 0)
    x, y = np.where(some, a, 1.0)[:, None], np.where(some, b, 1.0)[:, None]
    shared = np.exp(-np.where(some, union, 2.0)[:, None] * rates) - np.exp(-(x + y) * rates)
    total = (rates**2 * REGISTERS * shared / (np.expm1(-x * rates) * np.expm1(-y * rates))).sum(axis=1)
    return np.where(some, total / (_information(a) * _information(b)) - both, 0.0)


def algebra(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> dict[str, np.ndarray]:
    """est_ and err_ of union, both and only_a, from the bit counts of A, B and their merged sketch."""
    na, nb, nu = cardinality(a), cardinality(b), cardinality(u)
    nu = np.minimum(np.maximum(nu, np.maximum(na, nb)), na + nb)  # no smaller than a part, no larger than the sum
    both = na + nb - nu
    va, vb, vu = _covariance(na, na, na, na), _covariance(nb, nb, nb, nb), _covariance(nu, nu, nu, nu)
    ab, au, bu = _covariance(na, nb, nu, both), _covariance(na, nu, nu, na), _covariance(nb, nu, nu, nb)
    values = {"union": nu, "both": both, "only_a": nu - nb}
    spread = {"union": vu, "both": va + vb + vu + 2 * (ab - au - bu), "only_a": vu + vb - 2 * bu}
    most = 8 * nu / REGISTERS**0.5 + 3
    # Half a key is the least step that an estimate of a whole number leaves open.
    errors = {k: np.minimum(WIDTH * np.sqrt(np.maximum(v, 0)) + 0.5 * (nu > 0), most) for k, v in spread.items()}
    return {f"est_{k}": np.maximum(v, 0).round(3) for k, v in values.items()} | {f"err_{k}": v.round(3) for k, v in errors.items()}


def estimates(df: DataFrame, a: str = "a_c", b: str = "b_c", u: str = "u_c") -> DataFrame:
    """Replaces the bit counts of A, B and their merged sketch by est_ and err_ columns; see :func:`algebra`."""
    kept = [c for c in df.columns if c not in (a, b, u)]

    def run(batches):
        for pdf in batches:
            counts = [np.array(pdf[c].tolist(), float).reshape(-1, BITS) for c in (a, b, u)]
            yield pdf[kept].assign(**algebra(*counts))

    fields = [df.schema[c] for c in kept] + [T.StructField(f"{s}_{k}", T.DoubleType()) for s in ("est", "err") for k in ("union", "both", "only_a")]
    return df.mapInPandas(run, T.StructType(fields))


def window_grid(keys: DataFrame) -> DataFrame:
    """(day, kind_a, kind_b): every day that holds a key with every ordered pair of kinds: the rows of the result."""
    seen = keys.groupBy("kind", "day").agg(F.count("*").alias("n"))
    days, kinds = seen.select("day").distinct(), seen.select(F.col("kind").alias("kind_a")).distinct()
    pair = kinds.join(kinds.withColumnRenamed("kind_a", "kind_b"))
    return days.join(pair)


def window_sketches(keys: DataFrame, days: int, shifts: list[int]) -> DataFrame:
    """(day, kind, register, bits): merged sketches of the ``days`` days that end at each day that holds a key, and ``shifts`` days before it."""
    daily = materialise(sketches(keys, "kind", "day"), "daily-sketches")
    wanted = daily.select("day").distinct().select(F.explode(F.array(*(F.col("day") - s for s in shifts))).alias("day")).distinct()
    spread = daily.select("kind", "register", "bits", F.explode(F.sequence(F.col("day"), F.col("day") + days - 1)).alias("day"))
    merged = spread.groupBy("kind", "register", "day").agg(F.bit_or("bits").alias("bits"))
    return merged.join(F.broadcast(wanted), "day", "left_semi")  # one row a day: bounded by the calendar


def exact(keys: DataFrame, grid: DataFrame, days: int, shift: int) -> DataFrame:
    """(day, kind_a, kind_b, n_a, n_b, n_both): distinct keys, counted by where a key's presence in a window begins and ends.

    A key's days of one kind make runs of days at which the window holds it; two kinds' runs
    meet within the key, and sums of beginnings and ends over the calendar are the counts.
    """
    w = Window.partitionBy("key", "kind").orderBy("day")
    # A run goes on while the next day lies within the window: at most one row a day, kind and key.
    begun = keys.withColumn("new", F.coalesce((F.col("day") - F.lag("day").over(w) > days).cast("int"), F.lit(1)))
    runs = begun.withColumn("run", F.sum("new").over(w)).groupBy("key", "kind", "run").agg(F.min("day").alias("lo"), (F.max("day") + days).alias("hi"))
    runs = materialise(runs.drop("run"), "window-runs")
    a = runs.select("key", F.col("kind").alias("kind_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = runs.select("key", F.col("kind").alias("kind_b"), (F.col("lo") + shift).alias("lo_b"), (F.col("hi") + shift).alias("hi_b"))
    met = a.join(b.hint("merge"), "key").where((F.col("lo_a") < F.col("hi_b")) & (F.col("lo_b") < F.col("hi_a")))

    def changes(df: DataFrame, by: list[str], lo: Column, hi: Column) -> DataFrame:
        ends = F.array(F.struct(lo.alias("day"), F.lit(1).alias("d")), F.struct(hi.alias("day"), F.lit(-1).alias("d")))
        return df.select(*by, F.explode(ends).alias("x")).groupBy(*by, F.col("x.day").alias("day")).agg(F.sum("x.d").alias("d"))

    def counted(delta: DataFrame, by: list[str], wanted: DataFrame, name: str) -> DataFrame:
        """Running sums at the grid's days; the rows are days of the calendar, not of the input."""
        total = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*by).orderBy("day"))
        return wanted.withColumn("_w", F.lit(True)).join(delta, [*by, "day"], "full").withColumn(name, total).where("_w").drop("_w", "d")

    one = grid.select(F.col("kind_a").alias("kind"), "day").distinct()
    n_a = counted(changes(runs, ["kind"], F.col("lo"), F.col("hi")), ["kind"], one, "n_a").withColumnRenamed("kind", "kind_a")
    n_b = counted(changes(runs, ["kind"], F.col("lo") + shift, F.col("hi") + shift), ["kind"], one, "n_b").withColumnRenamed("kind", "kind_b")
    n_both = counted(changes(met, ["kind_a", "kind_b"], F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")), ["kind_a", "kind_b"], grid, "n_both")
    return n_both.join(n_a, ["kind_a", "day"]).join(n_b, ["kind_b", "day"])


def window_algebra(rows: DataFrame, kind: str, time: str, key: str, days: int = 14, shift: int = 7) -> DataFrame:
    """A: a kind's keys in the ``days`` days up to a day; B: another's in those up to ``shift`` days before.

    Returns a row for every day with a used row and every ordered pair of kinds: day, kind_a,
    kind_b, exact n_union, n_both, n_only_a, and est_ and err_ columns from merged sketches alone.
    """
    keys = materialise(daily_keys(rows, kind, time, key), "daily-keys")
    grid = materialise(window_grid(keys), "window-grid")
    merged = materialise(window_sketches(keys, days, [0, shift]), "window-sketches")
    # Pairs of bitmaps by register: the grid is repeated over the registers that either side has.
    a = merged.select("day", "register", F.col("kind").alias("kind_a"), F.col("bits").alias("a"))
    b = merged.select((F.col("day") + shift).alias("day"), "register", F.col("kind").alias("kind_b"), F.col("bits").alias("b"))
    every = grid.select("day", "kind_a", "kind_b", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))).alias("register"))
    sides = every.join(a.hint("merge"), ["day", "register", "kind_a"], "left").join(b.hint("merge"), ["day", "register", "kind_b"], "left")
    both = sides.withColumn("u", F.coalesce("a", F.lit(0).cast("long")).bitwiseOR(F.coalesce("b", F.lit(0).cast("long"))))
    counts = materialise(occupancy(both, ["day", "kind_a", "kind_b"], ["a", "b", "u"]), "bit-counts")
    out = estimates(counts).join(exact(keys, grid, days, shift).hint("merge"), ["day", "kind_a", "kind_b"])
    n = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return out.select("day", "kind_a", "kind_b", n.alias("n_union"), "n_both", (F.col("n_a") - F.col("n_both")).alias("n_only_a"), *(f"{s}_{k}" for s in ("est", "err") for k in ("union", "both", "only_a")))
