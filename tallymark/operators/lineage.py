"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, a folder of this machine is made, which only a plain local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local.append(tempfile.mkdtemp(prefix="tallymark-"))
        base = "file://" + _local[-1]
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`clean_up` removes."""
    path = f"{shared_dir(spark)}/tallymark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def checkpointed(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written as Parquet and read back; removed by :func:`clean_up`, at the latest when the driver ends."""
    spark = df.sparkSession
    path = written(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up() -> None:
    """Remove the written tables; for a driver that has saved a query's result and goes on."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder goes with the cluster's
            continue


def _at_exit() -> None:
    clean_up()
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_exit)
