"""Byte-level BPE by a global distinct-word shuffle.

Documents are cut into blocks of bounded size.  A block keeps its pre-tokens as a
dictionary of distinct words plus the packed sequence of word numbers by position, so a
word travels once a block and not once an occurrence.  The distinct words of all blocks
meet by hash bucket, where each is encoded once; the ids go back to the blocks, and every
block is put together again by position.  Decoding joins the ids to the token-byte table,
whose size is that of the vocabulary, so every task holds it.

Defined cases: a null or empty text has no tokens; rows with equal or null ids stay
separate rows; other columns are ignored; an empty table gives an empty result.  A very
long text is a block of its own, cut and assembled whole; a long run without blanks is one
chunk, which the pattern cuts like any other.
"""

from __future__ import annotations

import base64
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import bucket_count, deal, pack_lists, pack_words, spread, unpack_lists, unpack_words
from .common import Numbering, block_number, give_back, materialise, pack, settled, text_rows, unpack

#: Characters after which a block is closed; one longer text is a block of its own.
BLOCK_CHARS = 8_000_000
_UNEVEN = re.compile(r"\s | \s")
_GAP = re.compile(r"(?<=\S) (?=\S)")


def space_chunks(text: str) -> list[str]:
    """Cut before each single space between non-spaces, which always starts a pre-token."""
    mark = next((c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text), None)
    if mark is None:  # every private-use character occurs in the text
        first, *rest = _GAP.split(text)
        return [first, *(" " + r for r in rest)]
    if _UNEVEN.search(text) or text[:1] == " " or text[-1:] == " ":
        return _GAP.sub(mark + " ", text).split(mark)
    return text.replace(" ", mark + " ").split(mark)


def cut_chunks(find, chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all chunks in order, and how many each chunk has.

    Chunks that meet at a single space between non-spaces are cut together: a pre-token
    always starts there.
    """
    starts = [i for i, c in enumerate(chunks) if i == 0 or c[0] != " " or c[1:2].isspace() or len(c) < 2 or chunks[i - 1][-1].isspace()]
    found: list[str] = []
    for a, b in pairwise([*starts, len(chunks)]):
        found += find("".join(chunks[a:b]))
    covered = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    wanted = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    ends = np.searchsorted(covered, wanted) + 1
    if len(chunks) and (ends[-1] != len(found) or (covered[ends - 1] != wanted).any()):
        each = list(map(find, chunks))  # the pattern leaves characters out
        return [w for f in each for w in f], np.fromiter(map(len, each), np.int64, len(each))
    return found, np.diff(ends, prepend=0)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _blocks(batches, pattern: str, block_chars: int, buckets: int, schema: pa.Schema, heads: bool):
    """The blocks' sequences if ``heads``, else their words: the same blocks either way."""
    import regex

    find = regex.compile(pattern).findall
    number = block_number()
    chunks, ids, sizes, parts, chars = Numbering(), [], [], [], 0

    def close():
        nonlocal number, chunks, ids, sizes, parts, chars
        pretokens = Numbering()
        found, width = cut_chunks(find, list(chunks))
        flat = np.fromiter(map(pretokens.__getitem__, found), np.int64, len(found))
        seen = np.concatenate(parts)
        seq = flat[spread((np.cumsum(width) - width)[seen], width[seen])]
        ends = np.concatenate([[0], np.cumsum(width[seen])])[np.concatenate([[0], np.cumsum(sizes)])]
        lengths = np.diff(ends).tolist()
        words = [w.encode() for w in pretokens]
        place, dealt = deal(words, buckets)
        rows, checks = [], []
        for b, own in dealt:
            mine = [words[i] for i in own]
            checks.append(zlib.crc32(b"\0".join(mine)))
            if not heads:
                rows.append((number, b, None, None, pack_words(mine), checks[-1]))
        if heads:
            rows.append((number, -1, ids, lengths, pack(place[seq]), _joined(checks)))
        number += 1
        chunks, ids, sizes, parts, chars = Numbering(), [], [], [], 0
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for doc_id, text in text_rows(batches):
        found = space_chunks(text) if text else []
        parts.append(np.fromiter(map(chunks.__getitem__, found), np.int32, len(found)))
        ids.append(doc_id)
        sizes.append(len(found))
        chars += len(text or "") + 16
        if chars >= block_chars:
            yield close()
            give_back()
    if ids:
        yield close()
        give_back()


def _joined(checks: list[int]) -> int:
    """One checksum of a block's buckets, in order."""
    return zlib.crc32(np.array(checks, "<u4").tobytes())


def _encode_words(batches, path: str, pattern: str, schema: pa.Schema):
    """Rows sorted by bucket: a bucket's words are encoded once each."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    now, known = -1, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, known = row["bucket"], {}
            found = []
            for word in unpack_words(row["data"]):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(encoding.encode_ordinary(word.decode()), "<u4").tobytes()
                found.append(ids)
            row["data"] = pack_lists(np.fromiter(map(len, found), np.uint32, len(found)), b"".join(found))
            yield pa.RecordBatch.from_pylist([row], schema)


def _assemble(batches, tokens, out: pa.Schema, most: int = 400_000):
    """Rows sorted by block and bucket, a block's sequence first."""
    pool, starts, size = tokens.value

    def flush(head, parts):
        if _joined([p[2] for p in parts]) != head["check"]:
            raise ValueError("a block's words are not those of its sequence")
        sizes = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(p[1] for p in parts), "<u4").astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        seq, ends = unpack(head["data"]).astype(np.int64), np.cumsum(head["lengths"])
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            part = seq[done : int(ends[to - 1])]
            line = flat[spread(offsets[part], sizes[part])]
            text = pool[spread(starts[line], size[line])]
            counts = np.concatenate([[0], np.cumsum(sizes[part])])[np.concatenate([[0], ends[at:to] - done])]
            places = np.concatenate([[0], np.cumsum(size[line])])[counts]
            binary = lambda data, where: pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer(where.astype("<i8")), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["ids"][at:to], out.field(0).type), pa.array(np.diff(counts)), binary(line.astype("<u4").tobytes(), counts * 4), binary(text.tobytes(), places)],
                schema=out,
            )
            at = to

    head, parts = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                if head is not None:
                    yield from flush(head, parts)
                head, parts = row, []
            else:
                parts.append((*unpack_lists(row["data"]), row["check"]))
    if head is not None:
        yield from flush(head, parts)
    give_back()


def _token_pool(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each id's start and how many they are."""
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    pool = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
    return pool, np.cumsum(size) - size, size


def token_table(spark, path: str) -> DataFrame:
    """The token-byte table: id int, bytes binary.  Its size is that of the vocabulary."""
    rows = [(i, bytearray(b)) for b, i in read_ranks(path).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns ``id_col``, ``n_tokens`` long, ``ids_le`` binary (the ids as little-endian
    unsigned 32-bit integers) and ``decoded`` binary.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    # Both cuts must see the rows in one order.
    source = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "bpe-texts")
    id_type = source.schema["id"].dataType
    fields = [("block", T.LongType()), ("bucket", T.IntegerType()), ("ids", T.ArrayType(id_type)), ("lengths", T.ArrayType(T.LongType())), ("data", T.BinaryType()), ("check", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow, buckets = to_arrow_schema(schema), bucket_count(spark)
    # The texts are cut twice, into words and into sequences, so that sequences are shuffled
    # once only; a block's checksum holds the two together.
    part = lambda heads: source.mapInArrow(lambda it: _blocks(it, pattern, block_chars, buckets, arrow, heads), schema)
    met = part(False).repartition("bucket").sortWithinPartitions("bucket")
    encoded = met.mapInArrow(lambda it: _encode_words(it, path, pattern, arrow), schema)
    back = part(True).unionByName(encoded).repartition("block").sortWithinPartitions("block", "bucket")
    kinds = [(id_col, id_type), ("n_tokens", T.LongType()), ("ids_le", T.BinaryType()), ("decoded", T.BinaryType())]
    result = T.StructType([T.StructField(*k) for k in kinds])
    out, tokens = to_arrow_schema(result), spark.sparkContext.broadcast(_token_pool(path))
    return back.mapInArrow(lambda it: _assemble(it, tokens, out), result)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col`` and ``ids`` array<int> of every text."""
    whole = round_trip(docs, path, pattern, id_col, text_col)

    def unpacked(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    schema = T.StructType([whole.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.select(id_col, "ids_le").mapInArrow(unpacked, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Return ``id_col`` and ``decoded`` binary from ``ids``, by a join with the token-byte table.

    An id that the table lacks raises an error.
    """
    rows = materialise(encoded.select(F.monotonically_increasing_id().alias("_row"), id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), "bpe-ids")
    tokens = F.broadcast(token_table(encoded.sparkSession, path))
    pieces = rows.select("_row", F.posexplode("ids").alias("_n", "id")).join(tokens, "id", "left")
    pieces = pieces.withColumn("bytes", F.coalesce("bytes", F.raise_error(F.concat(F.lit("no such token: "), F.col("id"))).cast("binary")))
    texts = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_n", "bytes"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["bytes"])), ""))
    return rows.select("_row", id_col).join(texts.select("_row", joined.alias("decoded")), "_row", "left").select(id_col, F.coalesce("decoded", F.unhex(F.lit(""))).alias("decoded"))
