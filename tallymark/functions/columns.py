"""Column expressions that the operators share."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """A number in [0, 1) from the hash of the parts joined by ``|``; the same on any engine."""
    key = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash32(*parts) -> Column:
    key = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def char_at(text: Column, position) -> Column:
    return F.substring(text, position, 1)


def hamming(a: Column, b: Column, length: int) -> Column:
    """Differing positions of two strings of ``length`` characters."""
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + (char_at(a, i) != char_at(b, i)).cast("int")
    return out


def masked_keys(text: Column, length: int, distance: int) -> Column:
    """All copies of ``text`` with ``distance`` positions replaced by a wildcard."""
    def one(places):
        out, at = [], 1
        for p in places:
            out += [F.substring(text, at, p - at), F.lit("*")]
            at = p + 1
        return F.concat(*out, F.substring(text, at, length - at + 1))

    return F.array(*(one(p) for p in combinations(range(1, length + 1), distance)))


def identity(a: Column, b: Column, length: int) -> Column:
    """The share of equal positions."""
    return (F.lit(length) - hamming(a, b, length)) / F.lit(float(length))


def attention(query: Column, keys: Column, values: Column, width: int) -> Column:
    """Scaled dot-product attention of one query: ``keys`` and ``values`` are arrays of arrays of ``width``."""
    def dot(k: Column) -> Column:
        return F.aggregate(F.zip_with(query, k, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / F.lit(float(width) ** 0.5)

    def weighted(scores: Column) -> Column:
        shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
        return bind(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))

    def pooled(weights: Column) -> Column:
        at = lambda j: F.aggregate(F.zip_with(weights, values, lambda w, v: w * F.get(v, j).cast("double")), F.lit(0.0), lambda s, x: s + x)
        return F.array(*(at(j) for j in range(width)))

    return bind(bind(F.transform(keys, dot), weighted), pooled)


def or_na(value: Column, decimals: int, first: int | None = None) -> Column:
    """A number with so many decimals, or ``n/a``, as C's printf rounds: by the exact binary value, ties to even.

    With ``first`` it is rounded to so many decimals before, half away from zero; a negative zero keeps its sign.
    """
    scale = 10.0**first if first is not None else 1.0

    @F.pandas_udf("string")
    def text(numbers: pd.Series) -> pd.Series:
        def one(v):
            if first is not None and math.isfinite(v):
                whole = math.floor(abs(v) * scale)
                v = math.copysign((whole + (abs(v) * scale - whole >= 0.5)) / scale, v)
            return f"%.{decimals}f" % v

        return numbers.map(one).astype("string") if len(numbers) else numbers.astype("string")

    # Nulls and NaN look alike to pandas.
    number = value.cast("double")
    return F.when(number.isNull(), "n/a").when(F.isnan(number), "nan").otherwise(text(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def r6(column: Column) -> Column:
    """Six decimals; zero has no sign."""
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def safe_divide(x: Column, by: Column) -> Column:
    """``x / by``, where a null or zero divisor counts as one."""
    return x / F.coalesce(F.nullif(by, F.lit(0.0)), F.lit(1.0))


def bind(value: Column, use) -> Column:
    """``use(value)``, with the value computed once although ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log probability of the token at ``index`` (from 1) under ``logits``."""
    def of(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
        return F.get(logits, index - 1).cast("double") - (top + F.log(total))

    return bind(F.array_max(logits).cast("double"), of)


def layer_norm(vector: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance, without parameters."""
    n = F.size(vector).cast("double")
    mean = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def centred(m: Column) -> Column:
        variance = F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n
        return bind(F.sqrt(variance + F.lit(eps)), lambda d: F.transform(vector, lambda x: (x.cast("double") - m) / d))

    return bind(mean, centred)


def clamp0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def on_grid(x: Column, step: float = 0.1, tolerance: float = 1e-9) -> Column:
    """Whether ``x`` is a multiple of ``step``."""
    scaled = x / F.lit(step)
    return F.abs(scaled - F.round(scaled)) <= F.lit(tolerance)


def tolerance(claim: Column) -> Column:
    """Half a unit in a quoted number's last decimal, at least 6e-4; 0.5 for integers.  ``claim`` is a string."""
    bare = F.regexp_replace(claim, r"0+$", "")
    decimals = F.when(F.contains(claim, F.lit(".")), F.length(F.substring_index(bare, ".", -1))).otherwise(0)
    return F.when(decimals == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.5) * F.pow(F.lit(10.0), -decimals), F.lit(6e-4)))
