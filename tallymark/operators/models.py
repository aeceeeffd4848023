"""Baselines and learners that consume the other operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash32, uniform
from .encode import vocabulary
from .grouped import by_group, fitted, letters_of
from .grouped import fit as fit_grouped
from .lineage import checkpointed
from .order import median, numbered, running
from .training import OneHot, fit, predicted


def group_median(train: DataFrame, rows: DataFrame, grp: str, y: str, out: str = "pred") -> DataFrame:
    """``rows`` with the training median of their group, or of all training rows for an unseen group."""
    train = checkpointed(train.select(grp, y), "train")
    own, whole = median(train, y, "_own", (grp,)), median(train, y, "_all")
    return rows.join(own, grp, "left").join(F.broadcast(whole)).withColumn(out, F.coalesce("_own", "_all")).drop("_own", "_all")


def seed_ensemble(df: DataFrame, row: list[str], pred: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """The mean over seeds for each row, and the long input it came from."""
    return df.groupBy(*row).agg(F.avg(pred).alias(pred)), df.select(*row, seed, pred)


def seed_spread(metrics: DataFrame, model: str, value: str) -> DataFrame:
    """(model, mean, spread): over a table with one metric a seed; spread is the range to four decimals."""
    return metrics.groupBy(model).agg(F.avg(value).alias("mean_metric"), F.round(F.max(value) - F.min(value), 4).alias("spread"))


def best_epoch(history: DataFrame, run: str, epoch: str, score: str, patience: int, margin: float = 1e-5) -> DataFrame:
    """(run, epoch, score): the epoch that early stopping picks from a recorded history."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(score).cast("double").alias("s"))))
    start = F.struct(F.lit(None).cast("int").alias("e"), F.lit(float("-inf")).alias("s"), F.lit(0).alias("stale"))

    def step(acc: Column, x: Column) -> Column:
        better = x["s"] > acc["s"] + margin
        after = F.struct(F.when(better, x["e"]).otherwise(acc["e"]).cast("int").alias("e"), F.when(better, x["s"]).otherwise(acc["s"]).alias("s"), F.when(better, 0).otherwise(acc["stale"] + 1).alias("stale"))
        return F.when(acc["stale"] >= patience, acc).otherwise(after)

    return history.groupBy(run).agg(F.aggregate(ordered, start, step).alias("best")).select(run, F.col("best.e").alias("epoch"), F.col("best.s").alias("score"))


def _shared_out(sizes: list[tuple[int, int]], want: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(size, split, have, count): how many of the clusters of each size a split takes, and what it had before.

    ``sizes``: (size, clusters) from the largest on.  A split's need falls by equal steps as it
    takes clusters of one size, so a run of equal clusters is a merge of falling sequences: it
    ends at a level of need, found by halving, and only needs at that level are dealt singly.
    """
    have, floor, out = np.zeros(len(want)), np.maximum(want, 1e-9), []
    for size, clusters in sizes:
        need = lambda took: (want - (have + took * size)) / floor

        def above(level):
            """How many steps of each split begin with a need above the level."""
            took = np.maximum(np.ceil((want - have - level * floor) / size), 0)
            took = np.minimum(took, clusters)
            while (more := (need(took) > level) & (took < clusters)).any():
                took = took + more
            while (less := (took > 0) & (need(took - 1) <= level)).any():
                took = took - less
            return took

        low, high = float(need(np.full(len(want), float(clusters))).min()) - 1.0, float(need(np.zeros(len(want))).max())
        for _ in range(200):  # until the two levels are neighbours
            mid = (low + high) / 2
            if not low < mid < high:
                break
            low, high = (mid, high) if above(mid).sum() > clusters else (low, mid)
        took = above(high)
        while took.sum() < clusters:
            took[int(np.argmax(need(took)))] += 1
        out += [(int(size), k, float(have[k]), int(n)) for k, n in enumerate(took) if n]
        have = have + took * size
    return out


#: Steps of a split that one row of the plan stands for.
_STEPS = 10_000


def greedy_split(groups: DataFrame, targets: dict[str, float], seed: int, stratum: str | None = None) -> DataFrame:
    """(cluster, n, split): clusters by falling size to the split that lacks most of its share.

    Clusters of one size are one step: how many of them each split takes, and in what order,
    follows from the sizes.  The driver sees the distinct sizes of a stratum and how many
    clusters have them; clusters are numbered within their size by hash and meet the
    splits' turns by number.  Ties in need go by the order of ``targets``.
    """
    names, shares = list(targets), np.array(list(targets.values()), float)
    spark = groups.sparkSession
    key = F.col(stratum).cast("string") if stratum else F.lit("")
    rows = checkpointed(groups.select("cluster", F.col("n").cast("long").alias("n"), F.coalesce(key, F.lit("\0null")).alias("_s")), "clusters")
    counted: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("_s", "n").agg(F.count("*").alias("k")).collect():
        counted.setdefault(r["_s"], []).append((r["n"], r["k"]))
    plan = []
    for s, sizes in counted.items():
        want = shares * sum(n * k for n, k in sizes)
        plan += [(s, size, split, have, float(want[split]), n) for size, split, have, n in _shared_out(sorted(sizes, reverse=True), want)]
    turns = spark.createDataFrame(plan, "_s string, n long, k int, have double, want double, took long")
    first = turns.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("took") - 1, F.lit(_STEPS).cast("long"))))
    steps = first.repartition("_s", "n", "at").withColumn("m", F.explode(F.sequence("at", F.least(F.col("at") + _STEPS, F.col("took")) - 1)))
    need = (F.col("want") - (F.col("have") + F.col("m") * F.col("n"))) / F.greatest("want", F.lit(1e-9))
    dealt = numbered(steps.select("_s", "n", "k", need.alias("need")), [-F.col("need"), F.col("k")], "_i", ("_s", "n"))
    placed = numbered(rows.withColumn("_h", hash32("greedy", seed, F.col("cluster"))), ["_h", "cluster"], "_i", ("_s", "n"))
    both = placed.join(dealt.select("_s", "n", "_i", "k").hint("merge"), ["_s", "n", "_i"])
    return both.select("cluster", "n", F.get(F.array(*map(F.lit, names)), F.col("k")).alias("split"))


def learning_curve(train: DataFrame, evaluation: DataFrame, cluster: str, grp: str, y: str, shares: list[float], seeds: list[int]) -> DataFrame:
    """(frac, seed, n_rows, rmse_log, rmse_floor): the group-median baseline, and the overall median, fitted on parts of the clusters."""
    spark = train.sparkSession
    sizes = checkpointed(train.groupBy(cluster).agg(F.count("*").alias("n")), "clusters")
    total, taken = sizes.agg(F.sum("n").alias("_t")), None
    for seed in seeds:
        one = running(sizes, [uniform("quota", seed, F.col(cluster)), cluster], {"_before": F.col("n")}).select(cluster, "_before", F.lit(seed).alias("seed"))
        taken = one if taken is None else taken.unionByName(one)
    levels = spark.createDataFrame([(float(s),) for s in shares], "frac double")
    kept = taken.join(F.broadcast(total)).join(F.broadcast(levels), F.col("_before") < F.round(F.col("_t") * F.col("frac"), 6)).select(cluster, "frac", "seed")
    part = checkpointed(train.select(cluster, grp, y).join(kept, cluster).select("frac", "seed", grp, y), "parts")
    own = median(part, y, "_own", ("frac", "seed", grp))
    whole = median(part, y, "_all", ("frac", "seed")).join(part.groupBy("frac", "seed").agg(F.count("*").alias("n_rows")), ["frac", "seed"])
    rows = evaluation.select(grp, y).join(F.broadcast(whole)).join(own, ["frac", "seed", grp], "left")
    error = lambda p: F.sqrt(F.avg(F.pow(p - F.col(y), 2)))
    return rows.groupBy("frac", "seed", "n_rows").agg(error(F.coalesce("_own", "_all")).alias("rmse_log"), error(F.col("_all")).alias("rmse_floor"))


def crossover(curve: DataFrame, better: str, worse: str) -> DataFrame:
    """One row: the smallest share from which on ``better`` has the smaller mean over seeds; null if there is none."""
    means = curve.groupBy("frac").agg(F.avg(better).alias("a"), F.avg(worse).alias("b")).withColumn("ahead", F.round("a", 9) < F.round("b", 9))
    behind = means.agg(F.max(F.when(~F.col("ahead"), F.col("frac"))).alias("last"))
    ahead = means.join(F.broadcast(behind)).where(F.col("ahead") & (F.col("last").isNull() | (F.col("frac") > F.col("last"))))
    return ahead.agg(F.min("frac").alias("frac"))


def mlp_predictions(train: DataFrame, held: DataFrame, rows: DataFrame, grp: str, text: str, y: str, alphabet: str, length: int, seeds: list[int], hidden: tuple[int, ...] = (64, 16), rounds: int = 20, patience: int = 4) -> DataFrame:
    """``rows`` with column ``pred``: the seeds' mean of networks on one-hot features, fitted on all training rows.

    An unseen group and a letter outside the alphabet count for nothing.
    """
    known = checkpointed(vocabulary(train, grp), "groups")
    count = known.count()
    model = OneHot(length * len(alphabet) + count, hidden)
    cells = [F.instr(F.lit(alphabet), F.substring(text, p, 1)) for p in range(1, length + 1)]
    places = [F.when((F.length(F.substring(text, p, 1)) == 1) & (c > 0), (p - 1) * len(alphabet) + c - 1).otherwise(-1).cast("int") for p, c in enumerate(cells, 1)]
    own = F.coalesce(F.col("_index") + length * len(alphabet), F.lit(-1)).cast("int")

    def ready(df):
        return df.join(known.withColumnRenamed("index", "_index"), grp, "left").withColumn("_cells", F.array(*places, own)).drop("_index")

    fitted = fit(ready(train), ready(held), model, F.col("_cells"), y, seeds, rounds, patience)
    return predicted(ready(rows), fitted, model, F.col("_cells")).drop("_cells")


def hurdle_predictions(train: DataFrame, rows: DataFrame, grp: str, text: str, y: str, alphabet: str, length: int, penalty: float = 1e-3) -> DataFrame:
    """``rows`` with ``p_positive``, ``level`` and their product ``pred`` (on the log scale).

    A classifier says whether y > 0, a regression on the positive rows how large it is; both on
    one-hot groups and letters.  An unseen group and a letter outside the alphabet count for nothing.
    """
    cells = letters_of(text, alphabet, length)
    ready = by_group(train.select(grp, cells.alias("_cells"), F.col(y).cast("double").alias("_y")), grp)
    whether = ready.withColumn("_pos", (F.col("_y") > 0).cast("double"))
    classifier = fit_grouped(whether, grp, "_cells", "_pos", len(alphabet), length, penalty, logistic=True)
    level = fit_grouped(ready.where("_y > 0"), grp, "_cells", "_y", len(alphabet), length, penalty, logistic=False)
    scored = fitted(fitted(rows.withColumn("_cells", cells), classifier, grp, "_cells", "_eta"), level, grp, "_cells", "level")
    return scored.withColumn("p_positive", 1 / (1 + F.exp(-F.col("_eta")))).withColumn("pred", F.col("p_positive") * F.col("level")).drop("_cells", "_eta")
