"""Language-model scores: a unigram base and online logistic context mixing.

Tokens are the words of the lower-cased text and one end.  The frequent words have codes
of so many bits as the training tokens call for (:func:`code_bits`), every other word is an
escape code followed by the word.  An escaped word is either one of the training text's, by its count there, or
spelled in bytes; the two add up, by the share of such tokens that Good and Turing expect
to be new.  Each bit of codes and bytes is predicted by several hashed-context predictors, whose counts are
summed over all training documents into tables that grow with the code, to a stated size.
Their stretched probabilities are combined by weights that are gated by the bit's place; the mixed
probability is then corrected by a table of its rounded values.  Weights, a bias and corrections are
refined online, per document (or per spelled word): after every symbol at first, later after
every few (:func:`step_width`).
The sum of the bits' costs is the text's, a proper probability of its tokens.

Documents are cut into blocks with a dictionary of distinct words.  The words of all blocks
meet by hash bucket, where they are counted and spelled once for the whole corpus; what a
block needs of them goes back to it once a word and not once an occurrence.

Defined cases: a null or wordless text is one end token; a null id counts as the text
'' in the split; rows with equal ids stay separate rows; with no training document
every count is zero and only the end's bits remain; other columns are ignored; a very long
text is a block of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import bucket_count, deal, pack_floats, pack_words, unpack_floats, unpack_words
from .common import Numbering, block_number, give_back, materialise, pack, text_rows, unpack

BLOCK_CHARS = 8_000_000
ESCAPE, END = 0, 1
#: Predictors: contexts of 0 to 2 tokens and the token before the last; of 1 to 4 bytes in a word.
TOKEN_PREDICTORS, BYTE_PREDICTORS = 4, 4
BYTE_SLOTS = 1 << 20
CHUNK_SLOTS = 1 << 15
RATE, CORRECTION_RATE = 0.01, 0.05
#: Mixed log odds are held within MOST; their corrections are in cells of half a unit, and corrected ones within twice MOST.
MOST, CELLS = 12, 49
#: Tokens whose contexts a learning task counts at once.
LEARNED_AT_ONCE = 1 << 21
SYMBOLS_A_STEP = 16


def step_width(at: int, step: int) -> int:
    """Symbols from place ``at`` on until the weights move: one, a quarter of ``step``, then ``step``."""
    return 1 if at < 32 else max(1, step // 4) if at < 256 else step


def code_bits(tokens: int) -> int:
    """Bits of a code for so many training tokens; predictors have 256 slots for each of its values.

    From 10 (2**18 slots) to 14 (2**22): every worker holds the tables, at most 80 MB.
    """
    return 10 + sum(tokens >= 1 << n for n in (19, 21, 30, 34))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def _blocks(batches, block_chars: int, buckets: int, schema: pa.Schema):
    number = block_number()
    words, ids, lengths, parts, chars = Numbering(), [], [], [], 0

    def close():
        nonlocal number, words, ids, lengths, parts, chars
        names = list(words)
        place, dealt = deal(names, buckets)
        seen = [p for i, p in zip(ids, parts, strict=True) if not held_out(i)]
        counts = np.bincount(np.concatenate(seen), minlength=len(names)) if seen else np.zeros(len(names), np.int64)
        lists = [{"bucket": b, "words": pack_words([names[i] for i in own]), "counts": pack(counts[own])} for b, own in dealt]
        row = {"block": number, "ids": ids, "lengths": lengths, "buckets": lists, "seq": pack(place[np.concatenate(parts)])}
        number += 1
        words, ids, lengths, parts, chars = Numbering(), [], [], [], 0
        return pa.RecordBatch.from_pylist([row], schema)

    for doc_id, text in text_rows(batches):
        found = tokens(text)
        parts.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
        ids.append(doc_id)
        lengths.append(len(found))
        chars += len(text or "") + 16
        if chars >= block_chars:
            yield close()
            give_back()
    if ids:
        yield close()
        give_back()


def _runs(batches, key: str):
    """Rows sorted by ``key``: (value, iterator over its rows), rows read as they come."""
    from itertools import groupby

    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: r[key])


def _count(batches, schema: pa.Schema, most: int):
    """A bucket's words with their counts, and the most frequent of them."""
    for bucket, rows in _runs(batches, "bucket"):
        total: dict[bytes, int] = {}
        for row in rows:
            for w, c in zip(unpack_words(row["words"]), unpack(row["counts"]).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        words = sorted(total)
        known = [w for w in words if total[w]]
        top = sorted(known, key=lambda w: (-total[w], w))[:most]
        ones = sum(total[w] == 1 for w in known)
        row = {"bucket": bucket, "words": pack_words(words), "counts": np.array([total[w] for w in words], "<i8").tobytes(), "n": sum(total.values()), "v": len(known), "ones": ones, "top": [{"c": total[w], "word": w} for w in top]}
        yield pa.RecordBatch.from_pylist([row], schema)


def _merge_top(batches, schema: pa.Schema, most: int):
    """One row: the most frequent words of all rows' lists."""
    top: list[tuple[int, bytes]] = []
    for batch in batches:
        for row in batch.to_pylist():
            top = sorted([*top, *((-t["c"], t["word"]) for t in row["top"])])[:most]
    yield pa.RecordBatch.from_pylist([{"top": [{"c": -c, "word": w} for c, w in top]}], schema)


def _mixed(*parts) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        out = (out ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


def _before(symbols: np.ndarray, starts: np.ndarray, back: int, fill: int) -> np.ndarray:
    """The symbol ``back`` places earlier in the same run; ``fill`` before its start."""
    out = np.full(len(symbols), fill, np.int64)
    out[back:] = symbols[:-back]
    for k in range(back):
        at = starts + k
        out[at[at < len(out)]] = fill
    return out


def token_contexts(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    one, two = _before(codes, starts, 1, END), _before(codes, starts, 2, END)
    return [np.zeros(len(codes), np.uint32), _mixed(one), _mixed(one, two + 1), _mixed(two + (1 << 12))]


def byte_contexts(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    before = [_before(flat, starts, k, 0) + k for k in range(1, BYTE_PREDICTORS + 1)]
    return [_mixed(*before[:n]) for n in range(1, BYTE_PREDICTORS + 1)]


def _spread(symbols: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The first ``k`` bits of each symbol as a number that tells slots of one context apart."""
    return ((1 << k) | (symbols >> (bits - k))).astype(np.uint32) * np.uint32(0x85EBCA6B)


def _slots(context: np.ndarray, spread: np.ndarray, slots: int) -> np.ndarray:
    return (context + spread) & np.uint32(slots - 1)  # contexts are mixed already


def _learn(tables: np.ndarray, symbols: np.ndarray, contexts: list[np.ndarray], bits: int) -> None:
    """Count the bits of ``symbols`` into ``tables`` (predictors, slots, 2)."""
    slots = tables.shape[1]
    for k in range(bits):
        spread = _spread(symbols, k, bits)
        bit = (symbols >> (bits - 1 - k)) & 1
        for p, context in enumerate(contexts):
            at = _slots(context, spread, slots).astype(np.int64) * 2 + bit
            tables[p] += np.bincount(at, minlength=2 * slots).reshape(slots, 2).astype(tables.dtype)


def bit_costs(model: np.ndarray, symbols: np.ndarray, contexts: list[np.ndarray], bits: int, starts: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Bits for each run of symbols, all runs in step, each with weights and corrections of its own.

    ``model``: (predictors, slots), the stretched probabilities that a bit is one.
    """
    n, slots = len(contexts), model.shape[1]
    total = np.zeros(len(starts))
    order = np.argsort(starts - ends, kind="stable")  # longest first, so those that go on are a prefix
    starts, sizes = starts[order], (ends - starts)[order]
    weights = np.zeros((bits, n + 1, len(starts)), np.float32)
    weights[:, :n] = 0.9 / n + 0.1
    corrections = np.zeros(len(starts) * CELLS, np.float32)
    at, last = 0, int(sizes[0]) if len(sizes) else 0
    while at < last:
        live = int(np.searchsorted(-sizes, -at, side="left"))
        width = min(step_width(at, step), last - at)
        place = starts[:live, None] + at + np.arange(width)
        valid = (at + np.arange(width)) < sizes[:live, None]
        place = np.minimum(place, len(symbols) - 1)
        symbol = symbols[place].astype(np.int32)
        context = [c[place] for c in contexts]
        middle = (np.arange(live) * CELLS + CELLS // 2)[:, None]
        odds = np.ones((live, width))  # the product of all bits' 1 / p
        for k in range(bits):
            spread = _spread(symbol, k, bits)
            sign = (((symbol >> (bits - 1 - k)) & 1) * 2 - 1).astype(np.float32)
            counted = sign * valid
            inputs = [model[p].take(_slots(c, spread, slots)) for p, c in enumerate(context)]
            w = weights[k]
            dot = w[n, :live, None] + w[0, :live, None] * inputs[0]
            for p in range(1, n):
                dot += w[p, :live, None] * inputs[p]
            np.clip(dot, -MOST, MOST, out=dot)
            cell = middle + np.rint(dot * 2).astype(np.int64)
            corrected = np.clip(dot + corrections.take(cell), -2 * MOST, 2 * MOST)
            gone = np.exp(-sign * corrected)
            odds *= 1 + gone
            np.add.at(corrections, cell.ravel(), (gone / (1 + gone) * counted * np.float32(CORRECTION_RATE)).ravel())
            gone = np.exp(-sign * dot)
            error = gone / (1 + gone) * counted * np.float32(RATE)
            for p in range(n):
                w[p, :live] += np.einsum("ij,ij->i", error, inputs[p])
            w[n, :live] += error.sum(axis=1)
        total[order[:live]] += np.where(valid, np.log2(odds), 0).sum(axis=1)
        at += width
    return total


def _packed(values: np.ndarray) -> bytes:
    """Counts as compressed byte planes."""
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1, 2)


def _rows(tables: np.ndarray, first: int):
    """A task's counts (chunk, salt, data); ``first`` is the first chunk's number."""
    salt, flat = block_number() >> 32, tables.reshape(-1, 2)
    found = [(first + at // CHUNK_SLOTS, _packed(part)) for at in range(0, len(flat), CHUNK_SLOTS) if (part := flat[at : at + CHUNK_SLOTS]).any()]
    columns = [[c for c, _ in found], [salt % 64] * len(found), [d for _, d in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "salt", "data"])


def coded(codes_of_words: np.ndarray, seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all documents with their ends, and where each document starts and ends."""
    ends = np.cumsum(lengths)
    stream = np.insert(codes_of_words[seq].astype(np.int64), ends, END)
    ends = ends + np.arange(1, len(lengths) + 1)
    return stream, ends - lengths - 1, ends


def _codes_of(words: list[bytes], codes) -> np.ndarray:
    return np.fromiter((codes.value.get(w, ESCAPE) for w in words), np.int64, len(words))


def _learn_tokens(batches, codes, bits: int):
    tables = np.zeros((TOKEN_PREDICTORS, 1 << (bits + 8), 2), np.int32)
    held: list[tuple] = []

    def learn():
        nonlocal held
        _learn(tables, np.concatenate([h[0] for h in held]), [np.concatenate(c) for c in zip(*(h[1] for h in held), strict=True)], bits)
        held = []

    for batch in batches:
        for row in batch.to_pylist():
            of_words = np.concatenate([np.zeros(0, np.int64), *(_codes_of(unpack_words(b["words"]), codes) for b in row["buckets"])])
            stream, starts, ends = coded(of_words, unpack(row["seq"]), np.array(row["lengths"], np.int64))
            train = np.repeat([not held_out(i) for i in row["ids"]], ends - starts)
            held.append((stream[train].astype(np.int32), [c[train] for c in token_contexts(stream, starts)]))
            if sum(len(h[0]) for h in held) >= LEARNED_AT_ONCE:
                learn()
    if held:
        learn()
    yield _rows(tables, 0)
    del tables
    give_back()


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    return flat, np.concatenate([[0], ends[:-1]]), ends


def _learn_bytes(batches, codes, first: int):
    tables = np.zeros((BYTE_PREDICTORS, BYTE_SLOTS, 2), np.int32)
    held: list[bytes] = []

    def learn():
        flat, starts, _ = _spelled(held)
        _learn(tables, flat, byte_contexts(flat, starts), 8)
        held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            held += [w for w, c in zip(unpack_words(row["words"]), np.frombuffer(row["counts"], "<i8").tolist(), strict=True) if c and w not in codes.value]
            if len(held) >= LEARNED_AT_ONCE >> 3:
                learn()
    if held:
        learn()
    yield _rows(tables, first)
    del tables
    give_back()


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one from (zeros, ones), drawn to even odds where little was seen."""
    zero, one = counts[:, 0], counts[:, 1]
    seen = zero + one
    return (np.log((one + 0.4) / (zero + 0.4)) * (seen / (seen + 1.0))).astype("<f4")


def _sum_chunks(batches, salted: bool):
    """Rows sorted by chunk (and salt): the sum of each run, holding one run's sum; at last its log odds."""
    key, total = None, None

    def row():
        data = _packed(total) if salted else stretched(total).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "salt", "data"])

    for batch in batches:
        for r in batch.to_pylist():
            now, counts = (r["chunk"], r["salt"] if salted else 0), _unpacked(r["data"])
            if now == key:
                total = total + counts
            else:
                if key is not None:
                    yield row()
                key, total = now, counts
    if key is not None:
        yield row()


def _summed(rows: DataFrame) -> DataFrame:
    schema = "chunk int, salt int, data binary"
    first = rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(lambda it: _sum_chunks(it, True), schema)
    return first.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda it: _sum_chunks(it, False), schema)


def escaped_bits(spelled: np.ndarray, counts: np.ndarray, escaped: int, ones: int) -> np.ndarray:
    """Bits of words after an escape, from their bits if spelled and their training counts.

    ``escaped``: training tokens after an escape; ``ones``: those that occur once.
    """
    new = (ones + 1) / (escaped + 2) if escaped else 1.0
    known = np.log2(np.maximum(counts, 1) * (1 - new) / max(escaped, 1) + 1e-300)
    return -np.where(counts > 0, np.logaddexp2(known, np.log2(new) - spelled), np.log2(new) - spelled)


def _look_up(batches, codes, model, escaped: int, ones: int, schema: pa.Schema):
    """Rows sorted by bucket and block, the bucket's counts first: what each block needs of its words."""
    for _, rows in _runs(batches, "bucket"):
        place: dict[bytes, int] = {}
        c = bits = code = size = np.zeros(0)
        for row in rows:
            words = unpack_words(row["words"])
            if row["block"] < 0:
                place = {w: i for i, w in enumerate(words)}
                c, code = np.frombuffer(row["counts"], "<i8"), _codes_of(words, codes)
                bits, size = np.zeros(len(words)), np.fromiter(map(len, words), np.int64, len(words))
                rare = np.flatnonzero(code == ESCAPE)
                for at in range(0, len(rare), 20_000):
                    own = rare[at : at + 20_000]
                    flat, starts, ends = _spelled([words[i] for i in own])
                    spelled = bit_costs(model.value[1], flat, byte_contexts(flat, starts), 8, starts, ends, 1)
                    bits[own] = escaped_bits(spelled, c[own], escaped, ones)
            else:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bucket": row["bucket"], "data": [pack_floats(x[at]) for x in (c, bits, code, size)]}], schema)


def _score(batches, model, code: int, n: int, v: int, c_end: int, names: list[str], id_type):
    """Rows sorted by block and bucket, a block's sequence first."""
    least = np.log10(n + v + 1)

    def flush(head, parts):
        c, spell, codes, size = (np.concatenate([np.zeros(0), *(p[k] for p in parts)]) for k in range(4))
        seq, lengths = unpack(head["seq"]).astype(np.int64), np.array(head["lengths"], np.int64)
        stream, starts, ends = coded(codes.astype(np.int64), seq, lengths)
        bits = bit_costs(model.value[0], stream, token_contexts(stream, starts), code, starts, ends, SYMBOLS_A_STEP)

        def by_doc(values):
            sums = np.concatenate([[0], np.cumsum(values)])
            at = np.cumsum(lengths)
            return sums[at] - sums[at - lengths]

        base = by_doc((np.log10(c + 1) - least)[seq]) + np.log10(c_end + 1) - least
        score = -(bits + by_doc(spell[seq])) * np.log10(2)
        n_bytes = by_doc(size[seq] + 1)
        columns = [pa.array(head["ids"], id_type), pa.array([held_out(i) for i in head["ids"]]), pa.array(lengths + 1), pa.array((by_doc(c[seq] > 0) + (c_end > 0)).astype(np.int64)), pa.array(np.full(len(lengths), n, np.int64)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(n_bytes, 1))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for _, rows in _runs(batches, "block"):
        head = next(rows)
        yield flush(head, [[unpack_floats(d) for d in r["data"]] for r in rows])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Return id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``score`` is the log10 probability of the text's tokens; ``bits_per_byte`` counts one
    byte for the gap after each word.
    """
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    part = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    fields = [("block", T.LongType()), ("ids", T.ArrayType(id_type)), ("lengths", T.ArrayType(T.LongType())), ("buckets", T.ArrayType(part)), ("seq", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow, buckets = to_arrow_schema(schema), bucket_count(spark)
    parts = materialise(source.mapInArrow(lambda it: _blocks(it, block_chars, buckets, arrow), schema), "lm-blocks")
    lists = parts.select("block", F.explode("buckets").alias("b")).select("block", "b.bucket", "b.words", "b.counts")
    text_id = F.coalesce(F.col("i").cast("string"), F.lit(""))
    c_end = parts.select(F.explode("ids").alias("i")).where(F.crc32(F.encode(text_id, "UTF-8")) % 7 != 2).count()
    # The words of held-out documents count here too, which is near enough for a size.
    bits = code_bits(parts.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0)
    most = (1 << bits) - 2
    summed = T._parse_datatype_string("bucket int, words binary, counts binary, n long, v long, ones long, top array<struct<c: long, word: binary>>")
    summed_arrow = to_arrow_schema(summed)
    counts = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _count(it, summed_arrow, most), summed)
    counts = materialise(counts, "lm-counts")
    totals = counts.agg(F.sum("n"), F.sum("v"), F.sum("ones")).first()
    n, v = (totals[0] or 0) + c_end, (totals[1] or 0) + (c_end > 0)
    # A list a task, then a list a group of tasks, each of at most ``most`` words.
    top = T._parse_datatype_string("top array<struct<c: long, word: binary>>")
    top_arrow = to_arrow_schema(top)
    merge = lambda it: _merge_top(it, top_arrow, most)
    lists_of_tasks = counts.select("top").mapInArrow(merge, top).repartition(8).mapInArrow(merge, top).collect()
    frequent = sorted((-t["c"], bytes(t["word"])) for r in lists_of_tasks for t in r["top"])[:most]
    escaped = (totals[0] or 0) + sum(c for c, _ in frequent)
    ones = (totals[2] or 0) - sum(c == -1 for c, _ in frequent)
    codes = spark.sparkContext.broadcast({w: i + 2 for i, (_, w) in enumerate(frequent)})
    rows, slots = "chunk int, salt int, data binary", 1 << (bits + 8)
    first = TOKEN_PREDICTORS * slots // CHUNK_SLOTS
    learned = parts.select("ids", "lengths", "buckets", "seq").mapInArrow(lambda it: _learn_tokens(it, codes, bits), rows)
    learned = learned.unionByName(counts.select("words", "counts").mapInArrow(lambda it: _learn_bytes(it, codes, first), rows))
    flat = np.zeros(TOKEN_PREDICTORS * slots + BYTE_PREDICTORS * BYTE_SLOTS, np.float32)
    for r in _summed(learned).collect():  # of a stated size: the predictors' slots
        flat[r["chunk"] * CHUNK_SLOTS :][:CHUNK_SLOTS] = np.frombuffer(r["data"], "<f4")
    model = spark.sparkContext.broadcast((flat[: TOKEN_PREDICTORS * slots].reshape(-1, slots), flat[TOKEN_PREDICTORS * slots :].reshape(-1, BYTE_SLOTS)))
    asked = lists.select("bucket", "block", "words", F.lit(None).cast("binary").alias("counts"))
    known = counts.select("bucket", F.lit(-1).cast("long").alias("block"), "words", "counts")
    answer = T._parse_datatype_string("block long, bucket int, data array<binary>")
    answer_arrow = to_arrow_schema(answer)
    found = known.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(lambda it: _look_up(it, codes, model, escaped, ones, answer_arrow), answer)
    heads = parts.select("block", F.lit(-1).alias("bucket"), "ids", "lengths", "seq")
    back = heads.unionByName(found, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [id_type, T.BooleanType(), *[T.LongType()] * 3, *[T.DoubleType()] * 3]
    out = T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)])
    kind = to_arrow_type(id_type)
    return back.mapInArrow(lambda it: _score(it, model, bits, n, v, c_end, names, kind), out)
