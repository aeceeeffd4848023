"""Substring dedup by sliding sentence spans.

A text is cut into sentences that together are the text again.  From each sentence on, and
up to each, the shortest run of at least ``run`` sentences and ``least_words`` words is
hashed (128 bits, of the hashes of its sentences), and so is a single sentence of at least
``long_words``.  Runs of both directions cover a repeated passage to its ends, however
short its sentences are.  Equal spans meet in one shuffle of hashes, which counts them
(combined on the map side) and finds the first by (doc_id, place); sentences that a later
copy covers are removed.

The spans are written once and the repeated ones' summary rows too, so both sides of the
join that finds the later copies are plain shuffles: the copies of a hot span are split
over tasks, each with that span's one summary row, by Spark's handling of skewed joins.

Defined cases: a null text stays null and an empty one empty; ids that are null come
after all others; rows with equal ids stay separate rows, ordered by their place in the
table; other columns are ignored; a very long text is cut whole, and one without any end
of a sentence is a single sentence; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, settled

#: A sentence ends after . ! or ? and a blank, or after a line end.
CUT = r"(?:(?<=[.!?][ \t])|(?<=\n))(?=\S)"
_CUT = re.compile(CUT, re.ASCII)


def sentences(text: str | None) -> list[str]:
    """The text's sentences; joined they are the text."""
    return _CUT.split(text) if text else []


def runs(words: np.ndarray, run: int, least_words: int, long_words: int) -> np.ndarray:
    """Distinct (first, end) of the spans of sentences that have so many words each."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n + 1)
    ahead = np.maximum(np.searchsorted(upto, upto + least_words, side="left"), at + run)
    back = np.minimum(np.searchsorted(upto, upto - least_words, side="right") - 1, at - run)
    single = np.flatnonzero(words >= long_words)
    found = [(at[ahead <= n], ahead[ahead <= n]), (back[back >= 0], at[back >= 0]), (single, single + 1)]
    codes = np.unique(np.concatenate([a * (n + 1) + b for a, b in found]))
    return np.stack([codes // (n + 1), codes % (n + 1)])


def _spans(batches, schema: pa.Schema, run: int, least_words: int, long_words: int):
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        rows, ids, firsts, sizes, keys = [], [], [], [], []
        for n, text in enumerate(batch.column(2).to_pylist()):
            if not text:
                continue
            bare = [s.encode().split() for s in sentences(text)]
            first, end = runs(np.fromiter(map(len, bare), np.int64, len(bare)), run, least_words, long_words)
            if not len(first):
                continue
            own = b"".join([digest(b" ".join(w)) for w in bare])
            keys += [digest(own[a:b]) for a, b in zip((first * 16).tolist(), (end * 16).tolist(), strict=True)]
            rows.append((n, len(first)))
            firsts.append(first)
            sizes.append(end - first)
        if not rows:
            continue
        place = np.repeat([r[0] for r in rows], [r[1] for r in rows])
        hashes = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        columns = [batch.column(0).take(pa.array(place)), batch.column(1).take(pa.array(place)), pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _remove(batches, schema: pa.Schema):
    """Rows (id, text, spans to remove): the text without them."""
    for batch in batches:
        for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
            texts, counts, removed = [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = sentences(text)
                gone = {k for s in spans or () for k in range(s["at"], s["at"] + s["size"])}
                texts.append("".join([s for k, s in enumerate(found) if k not in gone]) if gone else text)
                counts.append(len(found))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema=schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, least_words: int = 20, long_words: int = 20) -> DataFrame:
    """Return id_col, text_col without repeated sentences, n_sentences and n_removed (longs)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # Rows are numbered by their place in two scans, which must agree.
    texts = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "span-texts")
    source = texts.select(F.monotonically_increasing_id().alias("_row"), "id", "text")
    kind = source.schema["id"].dataType
    fields = [("_row", T.LongType()), ("id", kind), ("at", T.IntegerType()), ("size", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = to_arrow_schema(schema)
    rows = materialise(source.mapInArrow(lambda it: _spans(it, arrow, run, least_words, long_words), schema), "spans")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "_row", "at")
    # The size belongs to the key: a hash of hashes says how many there are.
    counted = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = materialise(counted.select("h1", "h2", F.col("first._row").alias("row1"), F.col("first.at").alias("at1")), "spans-repeated")
    later = rows.select("_row", "at", "size", "h1", "h2").join(first, ["h1", "h2"]).where((F.col("_row") != F.col("row1")) | (F.col("at") != F.col("at1")))
    gone = later.groupBy("_row").agg(F.collect_set(F.struct("at", "size")).alias("gone"))
    whole = source.join(gone, "_row", "left").select("id", "text", "gone")
    out = T.StructType([T.StructField(id_col, kind), T.StructField(text_col, T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    out_arrow = to_arrow_schema(out)
    return whole.mapInArrow(lambda it: _remove(it, out_arrow), out)
