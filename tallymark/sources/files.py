"""Sources and sinks: checked tables, result documents, content hashes and one-time guards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header and a fixed schema; a row that doesn't fit it is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_sorted_csv(df: DataFrame, path: str, *order: str, overwrite: bool = False) -> None:
    """A CSV in total order; several files, whose names are in that order too."""
    df.orderBy(*order).write.option("header", True).mode("overwrite" if overwrite else "errorifexists").csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): whole JSON files, the file named without its folder."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("json"))


def write_documents(df: DataFrame, path: str, *columns: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("errorifexists").text(path)


def columns_to_rows(documents: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Documents that hold a table as equally long lists, one row an entry: (row, columns).

    ``columns``: names and SQL types.  Lists of different lengths are an error.
    """
    schema = ", ".join(f"`{n}` array<{t}>" for n, t in columns)
    parsed = documents.select(F.from_json("json", schema).alias("d"))
    sizes = F.array_distinct(F.array(*(F.size(f"d.{n}") for n, _ in columns)))
    zipped = F.when(F.size(sizes) == 1, F.arrays_zip(*(F.col(f"d.{n}").alias(n) for n, _ in columns)))
    checked = F.coalesce(zipped, F.raise_error(F.lit("the columns of a document differ in length")).cast(T.ArrayType(T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in columns]))))
    return parsed.select(F.posexplode(checked).alias("row", "x")).select("row", *(F.col(f"x.{n}").alias(n) for n, _ in columns))


def content_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, sha256) of whole files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def require_hash(spark: SparkSession, path: str, sha256: str) -> None:
    """Fail unless the file at ``path`` has this content."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if found is None or found["h"] != sha256:
        raise ValueError(f"the content of {path} has changed")


def claim_once(spark: SparkSession, path: str, record: dict) -> None:
    """Leave a marker that may be left only once; a second call fails."""
    rows = spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("errorifexists").text(path)


def write_verified(df: DataFrame, path: str, *key: str) -> DataFrame:
    """Write Parquet, read it back and compare row count and an order-free checksum."""
    def summary(rows):
        return rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()

    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if summary(df) != summary(back):
        raise OSError(f"what was written to {path} reads back differently")
    return back


def write_unit(df: DataFrame, path: str, unit: str, value: str) -> None:
    """Add one unit of work's results; done again, it replaces only its own."""
    df.withColumn(unit, F.lit(value)).write.partitionBy(unit).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def finished_units(spark: SparkSession, path: str) -> DataFrame:
    """(unit, rows): the ledger of :func:`run_units`; a unit that was committed twice counts once."""
    schema = "unit string, rows long"
    ledger = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not ledger.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/ledger").groupBy("unit").agg(F.max("rows").alias("rows"))


def run_units(df: DataFrame, path: str, unit: str, work, together: int = 100) -> int:
    """Do ``work(rows)`` for all units of ``df`` that the ledger at ``path`` lacks, and say how many that were.

    Units are done ``together`` at a time, whole, in one job: results first, each unit
    replacing what an attempt that was cut off left of it, then the ledger's lines.  A unit
    is finished when its line is there, so a run that is stopped goes on with the others.
    Only the names of a batch reach the driver.  Rows without a unit take no part.
    """
    spark, done = df.sparkSession, 0
    named = df.where(F.col(unit).isNotNull()).withColumn("_unit", F.col(unit).cast("string"))
    while True:
        left = named.select("_unit").distinct().join(finished_units(spark, path).select(F.col("unit").alias("_unit")), "_unit", "left_anti")
        names = [r["_unit"] for r in left.orderBy("_unit").limit(together).collect()]
        if not names:
            return done
        wanted = F.broadcast(spark.createDataFrame([(n,) for n in names], "_unit string"))
        rows = named.join(wanted, "_unit", "left_semi")
        out = work(rows.drop("_unit")).withColumn("_unit", F.col(unit).cast("string"))
        out.write.partitionBy("_unit").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/results")
        counts = spark.read.schema(out.schema).parquet(f"{path}/results").groupBy("_unit").agg(F.count("*").alias("rows"))
        lines = wanted.join(counts, "_unit", "left").select(F.col("_unit").alias("unit"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
        lines.coalesce(1).write.mode("append").json(f"{path}/ledger")
        done += len(names)


def job_documents(df: DataFrame, chains: dict[str, str]) -> DataFrame:
    """A column ``yaml`` with one structure job a row; ``chains``: chain id to sequence column."""
    parts = [F.lit("version: 1\nsequences:\n")]
    for chain, column in chains.items():
        parts.append(F.format_string(f"  - protein:\n      id: {chain}\n      sequence: %s\n", F.col(column)))
    return df.withColumn("yaml", F.concat(*parts))


def matrix_table(spark: SparkSession, text: str) -> DataFrame:
    """(letter, vector) of a square matrix given as text: a header of letters, then a letter and numbers a line.

    An asymmetric matrix is an error.
    """
    lines = [line.split() for line in text.strip().splitlines()]
    letters, rows = lines[0], {line[0]: [float(x) for x in line[1:]] for line in lines[1:]}
    if sorted(rows) != sorted(letters) or any(rows[a][letters.index(b)] != rows[b][letters.index(a)] for a in letters for b in letters):
        raise ValueError("the matrix is not square and symmetric")
    return spark.createDataFrame([(a, rows[a]) for a in letters], "letter string, vector array<double>")


def write_manifest(df: DataFrame, path: str, valid_only_if: dict[str, str]) -> None:
    """One JSON document beside a table: its rows, columns, checksum, and what must hold for it to be used."""
    n, check = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()
    text = json.dumps({"rows": n, "columns": df.dtypes, "checksum": check, "valid_only_if": valid_only_if}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def require_manifest(df: DataFrame, path: str, now: dict[str, str]) -> DataFrame:
    """``df`` if it is what the manifest describes and all its conditions hold now, else an error."""
    told = json.loads(df.sparkSession.read.text(path, wholetext=True).first()["value"])
    broken = [k for k, v in told["valid_only_if"].items() if now.get(k) != v]
    if broken:
        raise ValueError(f"not valid here: {', '.join(sorted(broken))}")
    n, check = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()
    if (n, check, [list(t) for t in df.dtypes]) != (told["rows"], told["checksum"], told["columns"]):
        raise ValueError("the table is not the one that the manifest describes")
    return df


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, residue, name, atom, element, x, y, z): the atoms of mmCIF structure files, one task a file.

    Reads the ``_atom_site`` loop of each file; hydrogens are left out.
    """
    wanted = ("label_asym_id", "label_seq_id", "label_comp_id", "label_atom_id", "type_symbol", "Cartn_x", "Cartn_y", "Cartn_z")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                names, rows, inside = [], [], False
                for line in text.splitlines():
                    if line.startswith("_atom_site."):
                        names.append(line.split()[0].split(".", 1)[1])
                        inside = True
                    elif inside and line[:1] in ("#", "_", "l"):
                        break
                    elif inside and line.strip():
                        cells = dict(zip(names, line.replace('"', "").split(), strict=False))
                        if cells["type_symbol"] not in ("H", "D"):
                            a, r, c, n, e, *at = (cells[w] for w in wanted)
                            rows.append((file, a, int(r) if r.isdigit() else None, c, n, e, *map(float, at)))
                if rows:
                    out = pd.DataFrame(rows, columns=["file", "chain", "residue", "name", "atom", "element", "x", "y", "z"])
                    yield out.astype({"residue": "Int64"})

    raw = spark.read.option("pathGlobFilter", "*.cif").text(path, wholetext=True)
    named = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    return named.mapInPandas(parse, "file string, chain string, residue long, name string, atom string, element string, x double, y double, z double")
