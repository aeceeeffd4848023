"""What the operators share: reading tables, cutting lineage, packing integers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import checkpointed, clean_up, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read, not a recomputation."""
    return checkpointed(df, name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` if its rows are in the same order whenever they are computed, else a written copy.

    Rows read from files are; after a shuffle a recomputed partition may order its rows
    otherwise, and numbers given to them by place would change.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, name) if "Exchange" in plan else df


def block_number() -> int:
    """First number for the blocks of this task; a retried task gets the same."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def give_back() -> None:
    """Return a worker's freed memory to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has no such call
        return


def text_rows(batches, rows: int = 512):
    """(id, text) of the first two columns, a bounded number of texts in memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def fresh_name(name: str, columns: list[str]) -> str:
    """``name`` with underscores before it, as many as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name
