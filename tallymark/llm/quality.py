"""Quality classifier by co-training of two views.

One view sees a text's content (hashed words), the other what is known of the page:
source, language, length, and how its lines and characters are laid out.  For each target
(low quality, toxic) both are fitted on labelled documents; then, round by round, each view
scores all unlabelled documents, and of those that it is sure of the other view learns.  A
view is sure of a class where its calibrated chance to be wrong is ``SURER`` times smaller
than that of the class's share.  A third of the labelled documents, on which neither view is
fitted, calibrates: a view that, calibrated on one half of it, is no better on the other than
the class's share neither teaches nor counts; if neither is better, as with few labels, nothing
is taught and both count.  The combination of the views scores every document.

The fits use at most ``labelled`` labelled documents, and ``pseudo`` pseudo-labels a round
and view in the classes' proportions, both taken by hash of the id: of the pseudo-labels,
from among all documents of the table that the view is sure of.  ``pseudo`` bounds what a fit
holds; it is no cap on what is scored.  The models have a fixed size.  A round is one pass over the documents, and so is scoring; neither shuffles them.

Defined cases: labels with a null doc_id or value, and ids with conflicting labels, are
not used; with fewer than 20 usable labels, or fewer than four of a class, a target's
probability is its mean, at most half of what rejects, so nothing is rejected for it; a
null or empty text and null metadata are scored as such; a very long text is scored
whole; documents with a null id are scored but never learned from; rows stay separate
rows; an empty table gives an empty result.  Equal ids among pseudo-labels teach once, by the
row whose features come first; ties in the order of documents go by id; other columns, also
of names used here, are ignored and kept by :func:`accepted`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

WORD_SLOTS = 1 << 18
META_SLOTS = 1 << 10
#: Probability from which a document is rejected.
REJECT = 0.5
#: How many times less often than the class's share a view has to be wrong to be sure.
SURER = 5.0
#: What a pseudo-label counts for beside a label.
PSEUDO_WEIGHT = 0.2
#: Share of the class mean's loss below which a view counts as better.
BETTER = 0.95
TARGETS = (("low", "quality", 0), ("toxic", "toxic", 1))
_UPPER, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[\\]^_`{|}~"
_WORD = re.compile(r"[^\W\d_]+")


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): distinct lower-cased words, and one slot that all texts have."""
    words = set(_WORD.findall((text or "").lower()))
    slots = sorted({64 + zlib.crc32(w.encode()) % (WORD_SLOTS - 64) for w in words})
    return np.array([0, *slots], np.int32), np.ones(len(slots) + 1, np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a page: where it is from, how long it is and how it is laid out."""
    text = text or ""
    n, chars = max(text.count(" ") + text.count("\n"), 1), max(len(text), 1)
    lines, raw = text.split("\n"), text.encode()

    def part(these: bytes) -> float:
        return (len(raw) - len(raw.translate(None, these))) / chars

    shapes = [
        part(_UPPER),
        part(_DIGITS),
        part(_SYMBOLS),
        text.count("!") / n,
        text.count("|") / n,
        len(set(lines)) / len(lines),
        min(chars / n / 20, 2.0),
        min(len(lines) / n, 1.0),
        min(n, 1000) / 1000,
        float(n < 20),
        float(not text),
    ]
    # Steps of each shape, so that a linear model can bend.
    steps = [int(s * 8) if s < 1 else 8 for s in (min(v * f, 1.0) for v, f in zip(shapes[:5], (2, 4, 5, 1, 1), strict=True))]
    size = -1 if n_chars is None else int(n_chars).bit_length()
    keys = (f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}")
    values = np.array([*(3.0 * v for v in shapes), *[1.0] * (5 + len(keys))], np.float32)
    places = [*range(len(shapes)), *(16 + 9 * i + s for i, s in enumerate(steps)), *(64 + zlib.crc32(k.encode()) % (META_SLOTS - 64) for k in keys)]
    return np.array(places, np.int32), values


@dataclass
class Linear:
    """Logistic regression on sparse rows."""

    weights: np.ndarray
    bias: float

    def margin(self, rows) -> np.ndarray:
        slots, values, starts = rows
        if not len(starts):
            return np.zeros(0)
        return np.add.reduceat(self.weights[slots] * values, starts) + self.bias

    @classmethod
    def fit(cls, rows, y: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 200, decay: float = 1e-4, least: int = 4, plain: int = 64):
        """Logistic regression on slots scaled by their log odds, of rows that may count for less.

        Slots from ``plain`` on take part if at least ``least`` rows have them and they
        tell the classes apart; the scale lets few rows teach a telling slot much.
        """
        slots, values, starts = rows
        owner = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(slots))))
        present = values != 0
        weight = np.ones(len(y)) if weight is None else weight
        n, positive = weight.sum(), (weight * y).sum()
        ones = np.bincount(slots, weights=present * (weight * y)[owner], minlength=size)
        zeros = np.bincount(slots, weights=present * (weight * (1 - y))[owner], minlength=size)
        odds = np.log((ones + 0.5) / (positive + 1)) - np.log((zeros + 0.5) / (n - positive + 1))
        scale = np.where((ones + zeros >= least) & (np.abs(odds) >= 0.7), odds, 0)
        scale[:plain] = 1
        used = np.flatnonzero(scale)
        place = np.full(size, -1)
        place[used] = np.arange(len(used))
        kept = place[slots] >= 0
        owner, column, value = owner[kept], place[slots[kept]], values[kept] * scale[slots[kept]]
        w, g2, m, bias, bm, b2 = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0.0
        pull = weight * np.where(y > 0, 0.5 / max(positive, 1e-9), 0.5 / max(n - positive, 1e-9))
        for t in range(1, rounds + 1):
            z = np.bincount(owner, weights=w[column] * value, minlength=len(y)) + bias
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * pull
            grad = np.bincount(column, weights=value * r[owner], minlength=len(used)) + decay * w
            m, g2 = 0.9 * m + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
            bm, b2 = 0.9 * bm + 0.1 * r.sum(), 0.99 * b2 + 0.01 * r.sum() ** 2
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-6)
            bias -= 0.05 * (bm / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-6)
        weights = np.zeros(size, np.float32)
        weights[used] = w * scale[used]
        return cls(weights, float(bias))


def _dense_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of a few columns by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rows(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(p[0]) for p in parts]
    if not sizes:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


@dataclass
class View:
    """A target's model: both views, the calibration of each, how they combine, and who taught what."""

    models: list[Linear] | None
    calibrate: list | None
    mix: np.ndarray | None
    mean: float
    #: (round, teaching view, class, pseudo-labels)
    taught: list[tuple[int, int, int, int]]
    better: list[bool]

    def probability(self, text_rows, meta_rows, n: int) -> np.ndarray:
        if self.models is None:
            return np.full(n, self.mean)
        columns = [m.margin(rows) * c[0] + c[1] for m, rows, c in zip(self.models, (text_rows, meta_rows), self.calibrate, strict=True)]
        return _sigmoid(np.column_stack([*columns, np.ones(n)]) @ self.mix)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Target:
    """One target's training: both views' labelled rows, a third of them kept to calibrate."""

    def __init__(self, text, meta, y: np.ndarray):
        self.mean = float(y.mean()) if len(y) else 0.0
        self.usable = len(y) >= 20 and y.sum() >= 4 and (1 - y).sum() >= 4
        self.taught: list[tuple[int, int, int, int]] = []
        keep, half = np.zeros(len(y), bool), np.zeros(len(y), bool)
        for value in (0, 1):  # every third of each class, every other one of those in a half
            held = np.flatnonzero(y == value)[::3]
            keep[held], half[held[::2]] = True, True

        def pick(parts, where):
            return [p for p, k in zip(parts, where.tolist(), strict=True) if k]

        self.held, self.held_y, self.half = (_rows(pick(text, keep)), _rows(pick(meta, keep))), y[keep], half[keep]
        self.own, self.labelled = [[pick(text, ~keep), y[~keep]], [pick(meta, ~keep), y[~keep]]], int((~keep).sum())
        self.models, self.calibrate, self.loss, self.better, self.fresh = [None, None], [None, None], [np.inf, np.inf], [False, False], [0, 0]

    def _crossed(self, margin: np.ndarray) -> np.ndarray:
        """Probabilities on each half of the kept third, calibrated on the other."""
        out = np.zeros(len(margin))
        for one in (self.half, ~self.half):
            c = _dense_fit(margin[~one][:, None], self.held_y[~one])
            out[one] = _sigmoid(margin[one] * c[0] + c[1])
        return out

    def fit(self) -> None:
        """Fit the views, at first and after pseudo-labels; those that make a view worse on the kept third are taken back."""
        base = _loss(np.full(len(self.held_y), self.held_y.mean()), self.held_y)
        for v, size in ((0, WORD_SLOTS), (1, META_SLOTS)):
            if self.models[v] is not None and self.fresh[v] == 0:
                continue
            parts, target = self.own[v]
            weight = np.append(np.ones(self.labelled), np.full(len(target) - self.labelled, PSEUDO_WEIGHT))
            model = Linear.fit(_rows(parts), target, size, weight)
            margin = model.margin(self.held[v])
            loss = _loss(self._crossed(margin), self.held_y)
            if loss <= self.loss[v]:
                self.models[v], self.loss[v], self.better[v] = model, loss, loss < BETTER * base
                self.calibrate[v] = _dense_fit(margin[:, None], self.held_y)
            else:
                self.own[v] = [parts[: len(parts) - self.fresh[v]], target[: len(target) - self.fresh[v]]]
            self.fresh[v] = 0

    def bounds(self) -> dict[int, float]:
        """The probability of each class from which a view is sure of it."""
        return {1: 1 - (1 - self.mean) / SURER, 0: 1 - self.mean / SURER}

    def learn(self, view: int, features: list, value: int) -> None:
        self.own[view] = [self.own[view][0] + features, np.append(self.own[view][1], np.full(len(features), value))]
        self.fresh[view] += len(features)

    def view(self) -> View:
        if not self.usable:
            return View(None, None, None, min(self.mean, REJECT / 2), self.taught, [False, False])
        views = np.column_stack([m.margin(h) * c[0] + c[1] for m, h, c in zip(self.models, self.held, self.calibrate, strict=True)])
        use = np.array(self.better) | (not any(self.better))
        mix = np.zeros(3)
        mix[np.append(use, True)] = _dense_fit(views[:, use], self.held_y)
        return View(self.models, self.calibrate, mix, self.mean, self.taught, self.better)


def co_train(targets: dict[str, Target], label: Callable, rounds: int = 2, pseudo: int = 200) -> dict[str, View]:
    """Fit all targets.

    ``label(views, wanted, turn)`` gives {(target, teacher, value): [(text, meta) features]}:
    documents that the teaching view is sure of, at most ``wanted`` of each.  ``views`` has the
    model, the calibration and the bounds of every view that is better than its class's share.
    """
    used = {n: t for n, t in targets.items() if t.usable}
    for turn in range(rounds + 1):
        for t in used.values():
            t.fit()
        if turn == rounds or not used:
            break
        views = {(n, v): (t.models[v], t.calibrate[v], t.bounds()) for n, t in used.items() for v in (0, 1) if t.better[v]}
        wanted = {(n, v, value): max(1, int(pseudo * (t.mean if value else 1 - t.mean))) for n, t in used.items() for v in (0, 1) for value in (0, 1)}
        for (name, teacher, value), found in label(views, wanted, turn).items():
            learner = 1 - teacher
            used[name].taught.append((turn, teacher, value, len(found)))
            used[name].learn(learner, [f[learner] for f in found], value)
    return {n: t.view() for n, t in targets.items()}


def _features(batches):
    for batch in batches:
        ids, texts, sources, langs, sizes = (batch.column(i).to_pylist() for i in range(5))
        found = [(text_features(t), meta_features(s, g, n, t)) for t, s, g, n in zip(texts, sources, langs, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([f[v][k] for f in found], pa.list_(pa.int32() if k == 0 else pa.float32())) for v in (0, 1) for k in (0, 1)), batch.column(5), batch.column(6)],
            names=["id", "ts", "tv", "ms", "mv", "quality", "toxic"],
        )


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def column(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias("_" + name)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), column("source", "string"), column("lang", "string"), column("n_chars", "long"))


def _sure(batches, views, turn: int, schema: pa.Schema):
    """(target, view, value, place, id) of the documents that a view is sure of."""
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            ids, texts, sources, langs, sizes = (part.column(i).to_pylist() for i in range(5))
            rows = _rows([text_features(t) for t in texts]), _rows([meta_features(*x) for x in zip(sources, langs, sizes, texts, strict=True)])
            found = []
            for (name, view), (model, scale, bounds) in views.value.items():
                p = _sigmoid(model.margin(rows[view]) * scale[0] + scale[1])
                for value, trust in ((1, p), (0, 1 - p)):
                    found += [(name, view, value, zlib.crc32(f"{turn}|{ids[k]}".encode()), ids[k]) for k in np.flatnonzero(trust >= bounds[value]).tolist()]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    give_back()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 8_000, pseudo: int = 200, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict[str, View]:
    """The models of ``low`` (quality 0) and ``toxic``."""
    from pyspark.sql import Window
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    agreed = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.when(F.min(c) == F.max(c), F.min(c)).cast("int").alias(c) for c in ("quality", "toxic")))
    agreed = agreed.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    ranked = agreed.orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    source = _source(docs, id_col, text_col)
    id_type = source.schema["_id"].dataType
    kind = T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.ArrayType(t)) for n, t in (("ts", T.IntegerType()), ("tv", T.FloatType()), ("ms", T.IntegerType()), ("mv", T.FloatType()))), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])

    def features(wanted: DataFrame):
        """Features of the documents of a bounded list (_id, quality, toxic), which is broadcast."""
        chosen = source.join(F.broadcast(wanted), "_id").select("_id", "_text", "_source", "_lang", "_n_chars", "quality", "toxic")
        rows = chosen.mapInArrow(_features, kind).toArrow()
        columns = {n: rows.column(n).combine_chunks() for n in rows.column_names}

        def lists(name, kind):
            column = columns[name]
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(kind), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column.offsets) else 0)
            return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

        if not rows.num_rows:
            return []
        text, meta = (list(zip(lists(a, np.int32), lists(b, np.float32), strict=True)) for a, b in (("ts", "tv"), ("ms", "mv")))
        found = list(zip(*(columns[n].to_pylist() for n in ("id", "quality", "toxic")), text, meta, strict=True))
        return sorted(found, key=lambda r: (r[0], len(r[3][0]), r[3][0].tolist(), r[4][0].tolist()))

    known = features(ranked)
    targets = {name: Target([r[3] for r in known], [r[4] for r in known], np.array([r[1 if column == "quality" else 2] == value for r in known], float)) for name, column, value in TARGETS}
    free = source.where(F.col("_id").isNotNull()).select("_id", "_text", "_source", "_lang", "_n_chars")
    taken = labels.select(F.col(id_col).alias("id")).distinct()
    answer = T.StructType([T.StructField("target", T.StringType()), T.StructField("view", T.IntegerType()), T.StructField("value", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("id", id_type)])
    arrow = to_arrow_schema(answer)

    def label(views, wanted, turn):
        models = spark.sparkContext.broadcast(views)

        # Only ids are joined with the labelled ones, which don't take part.
        each = free.mapInArrow(lambda it: _sure(it, models, turn, arrow), answer).join(taken, "id", "left_anti")
        order = Window.partitionBy("target", "view", "value").orderBy("place", "id")
        top = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(wanted.values()))
        picks = [r for r in top.collect() if r["r"] <= wanted[r["target"], r["view"], r["value"]]]
        models.unpersist()
        ids = sorted({r["id"] for r in picks})
        own: dict = {}
        asked = spark.createDataFrame([(i, None, None) for i in ids], T.StructType([T.StructField("_id", id_type), *(T.StructField(n, T.IntegerType()) for n in ("quality", "toxic"))]))
        for r in features(asked) if ids else []:
            own.setdefault(r[0], (r[3], r[4]))
        out: dict = {}
        for r in sorted(picks, key=lambda r: (r["target"], r["view"], r["value"], r["r"])):
            out.setdefault((r["target"], r["view"], r["value"]), []).append(own[r["id"]])
        return out

    return co_train(targets, label, rounds, pseudo)


def _score(batches, models, names: list[str]):
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts, sources, langs, sizes = (part.column(i).to_pylist() for i in range(1, 5))
            text = _rows([text_features(t) for t in texts])
            meta = _rows([meta_features(*x) for x in zip(sources, langs, sizes, texts, strict=True)])
            low, toxic = (models.value[t].probability(text, meta, part.num_rows) for t in ("low", "toxic"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(low), pa.array(toxic), pa.array((1 - low) * (1 - toxic)), pa.array((low < REJECT) & (toxic < REJECT))], names=names)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Return id_col, p_low, p_toxic, score and keep for every document."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **bounds))
    source = _source(docs, id_col, text_col)
    names = [id_col, "p_low", "p_toxic", "score", "keep"]
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), *(T.StructField(n, T.DoubleType()) for n in names[1:4]), T.StructField("keep", T.BooleanType())])
    return source.mapInArrow(lambda it: _score(it, models, names), schema)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **bounds))
    order = [docs.columns.index(c) if c in docs.columns else None for c in (text_col, "source", "lang", "n_chars")]

    def filtered(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = [part.column(i).to_pylist() if i is not None else [None] * part.num_rows for i in order]
                text = _rows([text_features(t) for t in columns[0]])
                meta = _rows([meta_features(*x) for x in zip(*columns[1:], columns[0], strict=True)])
                low, toxic = (models.value[t].probability(text, meta, part.num_rows) for t in ("low", "toxic"))
                yield part.filter(pa.array((low < REJECT) & (toxic < REJECT)))

    return docs.mapInArrow(filtered, docs.schema)
