"""Dictionary blocks: many documents' words as distinct words and numbers by position.

A block's distinct words are dealt to buckets by hash.  Within a block, words are numbered
bucket by bucket in order of appearance, so a bucket's words travel as one packed list and need no numbers of
their own; what comes back for a bucket takes their place.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

from .common import pack, unpack


def bucket_count(spark) -> int:
    """Buckets follow the session's shuffle partitions, which follow the data."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_lists(lengths: np.ndarray, body: bytes) -> bytes:
    head = pack(lengths)
    return struct.pack("<I", len(head)) + head + zstandard.ZstdCompressor(level=3).compress(body)


def unpack_lists(data: bytes) -> tuple[np.ndarray, bytes]:
    n = struct.unpack_from("<I", data)[0]
    return unpack(data[4 : 4 + n]), zstandard.ZstdDecompressor().decompress(data[4 + n :])


def pack_words(words: list[bytes]) -> bytes:
    return pack_lists(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    lengths, body = unpack_lists(data)
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def pack_floats(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.asarray(values, "<f8").tobytes())


def unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<f8")


def deal(words: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Each word's new number, and for each bucket in order the old numbers of its words."""
    where = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(where, kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return number, [(int(where[p[0]]), p) for p in parts]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(shift, sizes) + np.arange(total)
