"""Fits on groups and letters against ML's own, run to their optima, and against plain cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import grouped, models

ALPHABET, LENGTH = "ACD", 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        g = f"g{int(rng.integers(0, 12)) if i % 3 else 0}"  # a third has one group
        text = "".join(rng.choice(list("ACDx"), LENGTH, p=[0.4, 0.3, 0.2, 0.1]))
        level = 0.6 + 0.1 * int(g[1:]) - 0.5 * text.count("C") + rng.normal() * 0.7
        rows.append((i, g if i % 50 else None, text, float(max(level, 0.0)), "train" if i % 5 else "val"))
    rows += [(9001, "unseen", "ACD", 0.5, "val"), (9002, "g3", "zzz", 0.0, "val"), (9003, "g3", "A", 0.2, "val"), (9004, "none_positive", "AAA", 0.0, "train"), (9005, "none_positive", "AAA", 0.1, "val")]
    return rows


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "id long, g string, text string, y double, split string").repartition(5)


def features(rows, names):
    """Dense one-hot rows of known groups and letters."""
    x = np.zeros((len(rows), len(names) + len(ALPHABET) * LENGTH))
    for r, (_, g, text, _, _) in zip(x, rows, strict=True):
        if g in names:
            r[names.index(g)] = 1
        for p, c in enumerate(text):
            if c in ALPHABET:
                r[len(names) + p * len(ALPHABET) + ALPHABET.index(c)] = 1
    return x


def test_hurdle_meets_the_optimum_of_ml(spark, table, data):
    """Thirty steps of L-BFGS, as before, are further from the optimum than this allows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    train, val = [r for r in data if r[4] == "train"], [r for r in data if r[4] == "val"]
    names = sorted({r[1] for r in train if r[1]})
    x, other = features(train, names), features(val, names)
    rows = spark.createDataFrame([(Vectors.dense(a), float(r[3] > 0), r[3]) for a, r in zip(x, train, strict=True)], ["features", "pos", "y"])
    c = LogisticRegression(labelCol="pos", regParam=1e-3, maxIter=2000, tol=1e-13).fit(rows)
    m = LinearRegression(labelCol="y", regParam=1e-3, solver="normal").fit(rows.where("pos = 1"))
    p = 1 / (1 + np.exp(-(other @ c.coefficients.toArray() + c.intercept)))
    level = other @ m.coefficients.toArray() + m.intercept
    part = lambda s: table.where(F.col("split") == s).drop("split")
    got = {r.id: r for r in models.hurdle_predictions(part("train"), part("val"), "g", "text", "y", ALPHABET, LENGTH).collect()}
    assert set(got) == {r[0] for r in val} and 0.05 < np.std(p)
    for r, a, b in zip(val, p, level, strict=True):
        assert abs(got[r[0]].p_positive - a) < 2e-6 and abs(got[r[0]].level - b) < 1e-6
        assert abs(got[r[0]].pred - got[r[0]].p_positive * got[r[0]].level) < 1e-12


def test_constant_targets_and_features(spark):
    rows = spark.createDataFrame([("a", "AC", 1.0), ("a", "AD", 1.0), ("a", "AC", 1.0)], "g string, text string, y double")
    got = models.hurdle_predictions(rows, rows, "g", "text", "y", ALPHABET, 2).collect()
    assert [(r.p_positive, r.level, r.pred) for r in got] == [(1.0, 1.0, 1.0)] * 3
    # One group and one first letter: only the second place can tell the rows apart.
    rows = spark.createDataFrame([("a", "AC", 1.0), ("a", "AD", 2.0), ("a", "AC", 1.5), ("a", "AD", 2.5)], "g string, text string, y double")
    ready = grouped.by_group(rows.select("g", grouped.letters_of("text", ALPHABET, 2).alias("cells"), "y"), "g")
    found = grouped.fit(ready, "g", "cells", "y", len(ALPHABET), 2, 1e-9, logistic=False)
    assert (found.letters[0] == 0).all() and [r.b for r in found.groups.collect()] == [0.0]
    assert [round(r.fit, 5) for r in grouped.fitted(ready, found, "g", "cells", "fit").orderBy("cells", "y").collect()] == [1.25, 1.25, 2.25, 2.25]


def test_only_letters_are_solved_on_the_driver(spark):
    """Ten times the groups send no more to the driver; ML's coefficients would."""
    seen = []
    for groups in (30, 300):
        rows = spark.range(3000).select(F.concat(F.lit("g"), F.col("id") % groups).alias("g"), F.element_at(F.array(*map(F.lit, ALPHABET)), (F.xxhash64("id") % 3 + 3).cast("int") % 3 + 1).alias("text"), ((F.xxhash64("id") % 7) > 0).cast("double").alias("y"))
        ready = grouped.by_group(rows.select("g", grouped.letters_of("text", ALPHABET, 1).alias("cells"), "y"), "g")
        found = grouped.fit(ready, "g", "cells", "y", len(ALPHABET), 1, 1e-3, logistic=True)
        assert found.groups.count() == groups
        seen.append(found.letters.size)
    assert seen == [3, 3]
