"""Strings to sparse features, in long form (key, index, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

#: The twenty amino acids in alphabetical order, a fixed value.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def positional_one_hot(df: DataFrame, key: str, text: str, alphabet: str = ALPHABET, keep: Column | None = None) -> DataFrame:
    """index = position * letters + letter, both from 0; a letter outside the alphabet has no entry.

    ``keep``: a condition on ``pos``, for some positions only.
    """
    cells = df.select(key, F.posexplode(F.split(text, "")).alias("pos", "c"))
    letter = F.instr(F.lit(alphabet), F.col("c"))
    cells = cells.withColumn("letter", letter).where("c <> '' and letter > 0")
    cells = cells.where(keep) if keep is not None else cells
    return cells.select(key, (F.col("pos") * len(alphabet) + F.col("letter") - 1).alias("index"), F.lit(1.0).alias("value"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(column, index) of the distinct values in order."""
    return numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "index")


def vocabulary_one_hot(df: DataFrame, key: str, column: str, known: DataFrame) -> DataFrame:
    """One entry a row; a value that the vocabulary lacks has none."""
    return df.select(key, column).join(known, column).select(key, "index", F.lit(1.0).alias("value"))


def blocks(parts: dict[str, tuple[DataFrame, int]], names: list[str], key: str) -> DataFrame:
    """Named feature blocks side by side; ``parts`` gives each block's rows and width.  An unknown name is an error."""
    out, offset = None, 0
    for name in names:
        if name not in parts:
            raise ValueError(f"no such feature block: {name}")
        rows, width = parts[name]
        moved = rows.select(key, (F.col("index") + offset).alias("index"), "value")
        out, offset = moved if out is None else out.unionByName(moved), offset + width
    if out is None:
        raise ValueError("no feature blocks")
    return out


def table_encode(df: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """Each letter's vector from ``table`` (letter, vector) at its position's offset; other letters are zeros, left out."""
    cells = df.select(key, F.posexplode(F.split(text, "")).alias("pos", "letter")).where("letter <> ''")
    found = cells.join(F.broadcast(table), "letter").select(key, "pos", F.size("vector").alias("width"), F.posexplode("vector").alias("k", "value"))
    return found.where("value <> 0").select(key, (F.col("pos") * F.col("width") + F.col("k")).alias("index"), F.col("value").cast("double").alias("value"))


def letter_table(spark, alphabet: str) -> DataFrame:
    """A small table (letter, vector) by rule: place in the alphabet, its square, and parity."""
    rows = [(c, [float(i), float(i * i), float(i % 2)]) for i, c in enumerate(alphabet)]
    return spark.createDataFrame(rows, "letter string, vector array<double>")
