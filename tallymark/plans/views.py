"""Views that give the star-schema tables the shape of grouped measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform

LETTERS = ("0123456789abcdef", "AACCDDEEFFGGHHII")
ALPHABET = "ACDEFGHI"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, seq9, y): one measurement a supplier and part."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.avg(F.greatest(F.col("l_quantity") - 10, F.lit(0.0))) / 10.0).alias("y"))
    seq = F.translate(F.substring(F.md5(F.concat(F.lit("pep|"), F.col("l_partkey").cast("string"))), 1, 9), *LETTERS)
    return rows.select(F.concat(F.lit("G"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")).alias("grp"), seq.alias("seq9"), "y")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` with yl = ln(1 + y), a good and a poor prediction pa and pb, and a split by string."""
    p = pairs(spark, sf_dir).withColumn("yl", F.log(1 + F.col("y")))
    noise = lambda tag: uniform(tag, F.col("grp"), F.col("seq9")) - 0.5
    u = uniform("split", F.col("seq9"))
    return p.withColumn("pa", F.col("yl") + 0.5 * noise("pa")).withColumn("pb", F.col("yl") + 2.0 * noise("pb")).withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, pseudo): strings of 34; five groups a family, which differ in one or two positions."""
    s = table(spark, sf_dir, "supplier")
    m = F.col("s_suppkey") % 5
    fam = (F.col("s_suppkey") - m).cast("string")
    base = F.substring(F.translate(F.concat(F.md5(F.concat(F.lit("fam|"), fam)), F.md5(F.concat(F.lit("fam2|"), fam))), *LETTERS), 1, 34)
    at = (6 * m).cast("int")
    pseudo = F.when(m == 0, base).otherwise(F.concat(F.substring(base, F.lit(1), at - 1), F.lit("W"), F.substring(base, at + 1, F.lit(34))))
    return s.select(F.concat(F.lit("G"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("grp"), pseudo.alias("pseudo"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, hla): 182 characters, the group's string between fillers."""
    g = groups(spark, sf_dir)
    filler = lambda tag, n: F.substring(F.translate(F.concat(*(F.md5(F.concat(F.lit(f"{tag}{i}|"), F.col("grp"))) for i in range(3))), *LETTERS), 1, n)
    return g.select("grp", F.concat(filler("left", 74), F.col("pseudo"), filler("right", 74)).alias("hla"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq): the distinct strings of ``pairs``."""
    return pairs(spark, sf_dir).select(F.col("seq9").alias("seq")).distinct()


#: The same views in DuckDB SQL, to put before a query.
SQL = """WITH RECURSIVE pairs AS (SELECT 'G' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS grp,
  translate(substr(md5('pep|' || CAST(l_partkey AS VARCHAR)), 1, 9), '0123456789abcdef', 'AACCDDEEFFGGHHII') AS seq9,
  avg(greatest(l_quantity - 10, 0)) / 10.0 AS y FROM lineitem GROUP BY l_suppkey, l_partkey),
u AS (SELECT grp, seq9, y, ln(1 + y) AS yl,
  CAST(CAST('0x' || substr(md5('pa|' || grp || '|' || seq9), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS ua,
  CAST(CAST('0x' || substr(md5('pb|' || grp || '|' || seq9), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS ub,
  CAST(CAST('0x' || substr(md5('split|' || seq9), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS us FROM pairs),
preds AS (SELECT grp, seq9, y, yl, yl + 0.5 * (ua - 0.5) AS pa, yl + 2.0 * (ub - 0.5) AS pb,
  CASE WHEN us < 0.8 THEN 'train' WHEN us < 0.9 THEN 'val' ELSE 'test' END AS split FROM u),
fams AS (SELECT s_suppkey, s_suppkey % 5 AS m, substr(translate(md5('fam|' || CAST(s_suppkey - s_suppkey % 5 AS VARCHAR)) || md5('fam2|' || CAST(s_suppkey - s_suppkey % 5 AS VARCHAR)), '0123456789abcdef', 'AACCDDEEFFGGHHII'), 1, 34) AS base FROM supplier),
groups_ AS (SELECT 'G' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS grp, CASE WHEN m = 0 THEN base ELSE substr(base, 1, 6 * m - 1) || 'W' || substr(base, 6 * m + 1) END AS pseudo FROM fams),
domains AS (SELECT grp, substr(translate(md5('left0|' || grp) || md5('left1|' || grp) || md5('left2|' || grp), '0123456789abcdef', 'AACCDDEEFFGGHHII'), 1, 74) || pseudo || substr(translate(md5('right0|' || grp) || md5('right1|' || grp) || md5('right2|' || grp), '0123456789abcdef', 'AACCDDEEFFGGHHII'), 1, 74) AS hla FROM groups_),
strings AS (SELECT DISTINCT seq9 AS seq FROM pairs),
val AS (SELECT * FROM preds WHERE split = 'val'), train AS (SELECT * FROM preds WHERE split = 'train'), test AS (SELECT * FROM preds WHERE split = 'test')
"""
