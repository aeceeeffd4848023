"""Small networks fitted on all rows, data-parallel.

Rows are dealt into shards of bounded size by hash.  In a round every shard starts from
the same weights, takes one pass of mini-batches over its rows and sends its weights
back; their mean by rows, summed in a tree, starts the next round.  The driver holds
weights only.  With one shard this is an ordinary fit.  The round with the least squared
error on the held rows is kept, and ``patience`` rounds without a better one end a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import checkpointed

#: Rows of a shard, all of which a task holds.
SHARD_ROWS = 50_000
#: Indices of a one-hot network's first table that a shard's rows have as marks.
FEW = 128


class Tail:
    """Hidden layers with rectifiers and one output, on dense inputs of a width."""

    def __init__(self, width: int, hidden: tuple[int, ...]):
        self.widths = [width, *hidden, 1]

    def start(self, rng: np.random.Generator) -> list[np.ndarray]:
        return [p for a, b in zip(self.widths[:-1], self.widths[1:], strict=True) for p in (rng.normal(0, np.sqrt(2 / a), (a, b)) * (0.1 if b == 1 else 1.0), np.zeros(b))]

    def forward(self, params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        values = [x]
        for k in range(0, len(params), 2):
            z = values[-1] @ params[k] + params[k + 1]
            values.append(np.maximum(z, 0) if k + 2 < len(params) else z)
        return values

    def backward(self, params: list[np.ndarray], values: list[np.ndarray], back: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the layers, and that of the input."""
        grads: list = [None] * len(params)
        for k in range(len(params) - 2, -1, -2):
            grads[k], grads[k + 1] = values[k // 2].T @ back, back.sum(axis=0)
            back = back @ params[k].T
            if k:
                back = back * (values[k // 2] > 0)
        return grads, back


class MeanPool:
    """The mean of a row's vectors, then a tail.  Input: an array of ``places`` times ``width`` numbers."""

    kind = "<f8"

    def __init__(self, places: int, width: int, hidden: tuple[int, ...]):
        self.shape, self.tail = (places, width), Tail(width, hidden)

    def inputs(self, column: np.ndarray) -> np.ndarray:
        return np.asarray(column, float).reshape(-1, *self.shape)

    def start(self, rng):
        return self.tail.start(rng)

    def predict(self, params, x):
        return self.tail.forward(params, x.mean(axis=1))[-1][:, 0]

    def gradient(self, params, x, y):
        values = self.tail.forward(params, x.mean(axis=1))
        return self.tail.backward(params, values, (values[-1] - y[:, None]) / len(y))[0]


class Attention:
    """A row's vectors, weighted by the softmax of their products with a learned query, then a tail."""

    def __init__(self, places: int, width: int, hidden: tuple[int, ...]):
        self.shape, self.tail = (places, width), Tail(width, hidden)

    kind, inputs = MeanPool.kind, MeanPool.inputs

    def start(self, rng):
        return [rng.normal(0, 0.1, self.shape[1]), *self.tail.start(rng)]

    def _weights(self, query, x):
        s = x @ query / math.sqrt(self.shape[1])
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, params, x):
        return self.tail.forward(params[1:], np.einsum("np,npd->nd", self._weights(params[0], x), x))[-1][:, 0]

    def gradient(self, params, x, y):
        a = self._weights(params[0], x)
        values = self.tail.forward(params[1:], np.einsum("np,npd->nd", a, x))
        grads, back = self.tail.backward(params[1:], values, (values[-1] - y[:, None]) / len(y))
        by_place = np.einsum("npd,nd->np", x, back)
        scores = a * (by_place - (a * by_place).sum(axis=1, keepdims=True))
        return [np.einsum("np,npd->d", scores, x) / math.sqrt(self.shape[1]), *grads]


class OneHot:
    """A sum of learned vectors, one for each index of a row (negative ones count for nothing), a rectifier and a tail."""

    def __init__(self, count: int, hidden: tuple[int, ...]):
        self.count, self.width, self.tail = count, hidden[0], Tail(hidden[0], hidden[1:])
        self.kind = "<i2" if count < 1 << 15 else "<i4"

    def inputs(self, column: np.ndarray) -> np.ndarray:
        x = np.asarray(column, np.int64)
        return np.where(x < 0, self.count, x)

    def start(self, rng):
        return [rng.normal(0, 0.15, (self.count, self.width)), np.zeros(self.width), *self.tail.start(rng)]

    def _first(self, params, x):
        table = np.vstack([params[0], np.zeros((1, self.width))])
        first = np.tile(params[1], (len(x), 1))
        for k in range(x.shape[1]):
            first += table.take(x[:, k], axis=0)
        return np.maximum(first, 0, out=first)

    def predict(self, params, x):
        return self.tail.forward(params[2:], self._first(params, x))[-1][:, 0]

    def gradient(self, params, x, y):
        first = self._first(params, x)
        values = self.tail.forward(params[2:], first)
        grads, back = self.tail.backward(params[2:], values, (values[-1] - y[:, None]) / len(y))
        back = back * (first > 0)
        table = np.zeros((self.count + 1, self.width))
        for k in range(x.shape[1]):
            np.add.at(table, x[:, k], back)
        return [table[:-1], back.sum(axis=0), *grads]

    def touched(self, params, x, y):
        """The rows of the first table that a batch names, their gradients, and those of all other weights."""
        rows, place = np.unique(x, return_inverse=True)
        place = place.reshape(x.shape)
        marks = np.zeros((len(x), len(rows)))
        np.add.at(marks, (np.arange(len(x))[:, None], place), 1.0)
        known = rows < self.count
        rows, marks = rows[known], marks[:, known]
        first = np.maximum(marks @ params[0][rows] + params[1], 0)
        values = self.tail.forward(params[2:], first)
        grads, back = self.tail.backward(params[2:], values, (values[-1] - y[:, None]) / len(y))
        back = back * (first > 0)
        return rows, marks.T @ back, [back.sum(axis=0), *grads]

    def _split(self, x: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
        """Columns of few indices, the other columns, and the few indices, which the other columns don't name."""
        own = [np.flatnonzero(np.bincount(x[:, k], minlength=self.count)[: self.count]) for k in range(x.shape[1])]
        few, ids = [], np.zeros(0, np.int64)
        for k in sorted(range(len(own)), key=lambda k: len(own[k])):
            both = np.union1d(ids, own[k])
            if len(both) > FEW:
                break
            few, ids = [*few, k], both
        rest = [k for k in range(len(own)) if k not in few]
        if any(np.isin(own[k], ids).any() for k in rest):
            return [], list(range(len(own))), ids[:0]
        return few, rest, ids

    def one_pass(self, params, x, y, batch, rate, order):
        """Sparse Adam: of the first table a batch moves the rows it names only, so its work doesn't grow with the table.

        Indices of columns that have few (letters) are marks, whose table is moved as one matrix;
        those of other columns (groups) are sorted by batch once, and their rows gathered.
        """
        few, rest, ids = self._split(x)
        n, d, w = len(y), len(ids), self.width
        x, y = x[order], y[order].astype(np.float32)
        turn = np.arange(n) // batch
        batches = int(turn[-1]) + 1
        place = np.full(self.count + 1, d)  # an index that counts for nothing has a last column
        place[ids] = np.arange(d)
        marks, named = np.zeros(n * (d + 1), np.float32), np.zeros(batches * (d + 1), np.int64)
        for k in few:
            at = place[x[:, k]]
            marks[np.arange(n) * (d + 1) + at] += 1
            named += np.bincount(turn * (d + 1) + at, minlength=len(named))
        marks, named = marks.reshape(n, d + 1)[:, :d], named.reshape(batches, d + 1)[:, :d] > 0
        many = x[:, rest]
        keys = (turn[:, None] * (self.count + 1) + many).reshape(-1)
        by = np.argsort(keys, kind="stable")
        keys, sources = keys[by], by // max(1, len(rest))
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        rows = keys[starts] % (self.count + 1)
        ends = np.searchsorted(keys[starts], np.arange(batches + 1) * (self.count + 1))
        # A row's entries in a batch are added up by turns: all first ones, all second ones and so on.
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        nth = np.arange(len(keys)) - starts[run]
        later = np.flatnonzero(nth)
        laters = np.searchsorted(later, np.append(starts, len(keys))[ends])

        # Everything that each batch moves is one vector, of which the weights are views.
        like = [params[0][ids], *params[1:]]
        now = _flat(like).astype(np.float32)
        m, v, g, spare = (np.zeros_like(now) for _ in range(4))
        (head, *tail), grads = _shaped(now, like), _shaped(g, like)
        table = np.vstack([params[0], np.zeros((1, w))]).astype(np.float32)
        table_m, table_v = np.zeros_like(table), np.zeros_like(table)
        for t in range(1, batches + 1):
            low, high = (t - 1) * batch, min(t * batch, n)
            own = marks[low:high]
            first = own @ head
            for k in range(len(rest)):
                first += table.take(many[low:high, k], axis=0)
            first += tail[0]
            np.maximum(first, 0, out=first)
            values = self.tail.forward(tail[1:], first)
            found, back = self.tail.backward(tail[1:], values, (values[-1] - y[low:high, None]) / np.float32(high - low))
            back *= first > 0
            np.matmul(own.T, back, out=grads[0])
            for into, one in zip(grads[1:], [back.sum(axis=0), *found], strict=True):
                into[...] = one
            still = None if named[t - 1].all() else np.flatnonzero(~named[t - 1])
            if still is not None:
                views = [_shaped(z, like)[0] for z in (now, m, v)]
                kept = [z[still] for z in views]
            _adam(now, m, v, g, spare, t, rate)
            if still is not None:
                for z, before in zip(views, kept, strict=True):
                    z[still] = before
            if rest:
                a, b = ends[t - 1], ends[t]
                sums = back.take(sources[starts[a:b]] - low, axis=0)
                also, nth_time = later[laters[t - 1] : laters[t]], 1
                while len(also):
                    here = nth[also] == nth_time
                    sums[run[also[here]] - a] += back[sources[also[here]] - low]
                    also, nth_time = also[~here], nth_time + 1
                move = rows[a:b]
                p, pm, pv = (z.take(move, axis=0) for z in (table, table_m, table_v))
                _adam(p, pm, pv, sums, np.empty_like(p), t, rate)
                known = len(move) - int(move[-1] == self.count)  # the last row counts for nothing
                table[move[:known]], table_m[move[:known]], table_v[move[:known]] = p[:known], pm[:known], pv[:known]
        # Rows that none of these name stay as they are, to the last bit.
        out, moved = params[0].copy(), np.unique(rows[rows < self.count])
        out[moved], out[ids] = table[moved], head
        return [out, *(p.astype(float) for p in tail)]


def _adam(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, spare: np.ndarray, t: int, rate: float) -> None:
    """Step ``t`` of Adam in place."""
    m *= 0.9
    m += np.multiply(g, 0.1, out=spare)
    v *= 0.999
    np.multiply(g, g, out=spare)
    spare *= 0.001
    v += spare
    np.sqrt(v, out=spare)
    spare *= 1 / math.sqrt(1 - 0.999**t)
    spare += 1e-8
    np.divide(m, spare, out=spare)
    spare *= rate / (1 - 0.9**t)
    p -= spare


def one_pass(model, params: list[np.ndarray], x: np.ndarray, y: np.ndarray, batch: int, rate: float, rng: np.random.Generator) -> list[np.ndarray]:
    """One pass of Adam over mini-batches."""
    order = rng.permutation(len(y))
    if hasattr(model, "one_pass"):
        return model.one_pass(params, x, y, batch, rate, order)
    params, m, v = [p.copy() for p in params], [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t, at in enumerate(range(0, len(y), batch), 1):
        pick = order[at : at + batch]
        for i, g in enumerate(model.gradient(params, x[pick], y[pick])):
            _adam(params[i], m[i], v[i], g, np.empty_like(g), t, rate)
    return params


def _flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.reshape(-1) for p in params])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [part.reshape(p.shape) for part, p in zip(np.split(flat, cuts), like, strict=True)]


#: Bytes of a packed row, of which an Arrow batch holds up to 10,000.
_PACKED_BYTES = 2_048


def _binary(data: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Rows of ``data`` as binary values, each of as many rows as ``rows`` says."""
    each = data.nbytes // max(1, len(data))
    ends = np.append(0, np.cumsum(rows) * each).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _pack(batches, kind: np.dtype):
    """(shard, held, x, y) of rows sorted by shard and held: several rows' numbers in one, so that a round reads arrays."""
    for batch in batches:
        n, flat = len(batch), batch.column("x").flatten().to_numpy(zero_copy_only=False)
        if not n:
            continue
        if len(pc.unique(pc.list_value_length(batch.column("x")))) > 1:
            raise ValueError("features of rows differ in number")
        if kind.kind == "i":
            flat = np.maximum(flat, -1)
            if flat.max(initial=-1) > np.iinfo(kind).max:
                raise ValueError("an index is beyond the table")
        x, y = flat.reshape(n, -1).astype(kind), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        shard, held = batch.column("shard").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
        fresh = np.append(True, (shard[1:] != shard[:-1]) | (held[1:] != held[:-1]))
        most = max(1, _PACKED_BYTES // max(1, x.itemsize * x.shape[1] + 8))
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        cuts = np.flatnonzero((np.arange(n) - first) % most == 0)
        sizes = np.diff(np.append(cuts, n))
        yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(held[cuts]), _binary(x, sizes), _binary(y, sizes)], names=["shard", "held", "x", "y"])


def _numbers(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All numbers of an array of packed values."""
    if not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def _shards(batches, kind: np.dtype):
    """(number, features, targets, whether held) of each shard of packed rows sorted by shard, one held at a time."""
    kept, now = [], None

    def whole():
        x, y, held = (np.concatenate(c) for c in zip(*kept, strict=True))
        return now, x.reshape(len(y), -1), y, held

    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if kept and shard[a] != now:
                yield whole()
                kept = []
            now, own = shard[a], batch.slice(a, b - a)
            sizes = pc.binary_length(own.column(3)).to_numpy() // 8
            kept.append((_numbers(own.column(2), kind).copy(), _numbers(own.column(3), np.dtype("<f8")).copy(), np.repeat(own.column(1).to_numpy(zero_copy_only=False), sizes)))
    if kept:
        yield whole()


def fit(train: DataFrame, held: DataFrame, model, features: Column, y: str, seeds: list[int], rounds: int = 40, patience: int = 6, batch: int = 256, rate: float = 0.01) -> list[list[np.ndarray]]:
    """The weights of each seed.  Rows without features or target take no part; at least one row must train."""
    spark = train.sparkSession
    some = lambda df, part: df.select(features.alias("x"), F.col(y).cast("double").alias("y"), F.lit(part).alias("held")).where("x is not null and y is not null")
    rows = checkpointed(some(train, False).unionByName(some(held, True)), "to-fit")
    n, mean = rows.where("not held").agg(F.count("*"), F.avg("y")).first()
    if not n:
        raise ValueError("no row to fit on")
    shards = max(1, math.ceil(n / SHARD_ROWS))
    shard = F.pmod(F.xxhash64("x", "y", "held"), F.lit(shards))
    # A task takes several shards one after another and sends one sum of their weights.
    tasks = min(shards, max(8, 2 * spark.sparkContext.defaultParallelism))
    placed = rows.withColumn("shard", shard.cast("int")).repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "held", F.xxhash64("x", "y"), "y")
    kind = np.dtype(model.kind)
    dealt = placed.select("shard", "held", "x", "y").mapInArrow(lambda it: _pack(it, kind), "shard int, held boolean, x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
    like = model.start(np.random.default_rng(0))
    now = {}
    for s in seeds:
        params = model.start(np.random.default_rng(s))
        params[-1] += mean
        now[s] = _flat(params)
    best, stale = {s: (np.inf, now[s]) for s in seeds}, dict.fromkeys(seeds, 0)

    def one_round(number, active):
        weights = spark.sparkContext.broadcast({s: now[s] for s in active})

        def work(batches):
            """A shard's held error with the weights it gets, and its weights after a pass."""
            sums = {s: [0.0, 0, np.zeros_like(w), 0] for s, w in weights.value.items()}
            for k, features, target, out in _shards(batches, kind):
                x = model.inputs(features)
                for s, total in sums.items():
                    params = _shaped(weights.value[s], like)
                    for part in np.array_split(np.flatnonzero(out), max(1, -(-int(out.sum()) // 4096))) if out.any() else ():
                        total[0] += float(((model.predict(params, x[part]) - target[part]) ** 2).sum())
                        total[1] += len(part)
                    if not out.all():
                        after = one_pass(model, params, x[~out], target[~out], batch, rate / math.sqrt(number), np.random.default_rng([s, number, int(k)]))
                        total[2] += _flat(after) * int((~out).sum())
                        total[3] += int((~out).sum())
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(s, e, m, w.astype("<f8").tobytes(), c) for s, (e, m, w, c) in sums.items()], columns=["seed", "error", "held", "weights", "rows"]), schema=made)

        def summed(batches):
            total = {}
            for pdf in batches:
                for r in pdf.itertuples():
                    e, m, w, c = total.get(r.seed, (0.0, 0, 0.0, 0))
                    total[r.seed] = (e + r.error, m + r.held, w + np.frombuffer(r.weights, "<f8"), c + r.rows)
            yield pd.DataFrame([(s, e, m, w.astype("<f8").tobytes(), c) for s, (e, m, w, c) in total.items()], columns=["seed", "error", "held", "weights", "rows"])

        schema = "seed int, error double, held long, weights binary, rows long"
        made = pa.schema([("seed", pa.int32()), ("error", pa.float64()), ("held", pa.int64()), ("weights", pa.binary()), ("rows", pa.int64())])
        parts = dealt.mapInArrow(work, schema)
        if tasks > 8:  # a level of the tree
            parts = parts.repartition(math.ceil(math.sqrt(tasks))).mapInPandas(summed, schema)
        return pd.DataFrame(parts.collect(), columns=["seed", "error", "held", "weights", "rows"])

    active = list(seeds)
    for number in range(1, rounds + 2):
        if not active:
            break
        found = one_round(number, active)
        for s in list(active):
            own = found[found["seed"] == s]
            held_rows = own["held"].sum()
            error = own["error"].sum() / held_rows if held_rows else 0.0
            if number > 1 or not held_rows:
                if error < best[s][0] - 1e-9 or not held_rows:
                    best[s], stale[s] = (error, now[s]), 0
                else:
                    stale[s] += 1
            now[s] = sum(np.frombuffer(w, "<f8") for w in own["weights"]) / own["rows"].sum()
            if stale[s] >= patience:
                active.remove(s)
    dealt.unpersist()
    return [_shaped(best[s][1], like) for s in seeds]


def predicted(rows: DataFrame, fitted: list[list[np.ndarray]], model, features: Column, out: str = "pred") -> DataFrame:
    """``rows`` with the mean of the seeds' predictions; null without features."""
    weights = rows.sparkSession.sparkContext.broadcast(fitted)
    ready = rows.withColumn("_x", features)

    def score(batches):
        for pdf in batches:
            values, known = np.full(len(pdf), np.nan), pdf["_x"].notna().to_numpy()
            if known.any():
                x = model.inputs(np.stack(pdf["_x"][known].to_numpy()))
                values[known] = np.mean([model.predict(p, x) for p in weights.value], axis=0)
            yield pdf.drop(columns="_x").assign(**{out: values})

    done = ready.mapInPandas(score, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))
