"""The thin queries of the operators, and their SQL where SQL can express them.

The digest columns are derived here; the operators keep their general outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, contamination, distinct, lm, pii, prefix_bpe, quality, secrets, simhash, spans, token_files, trie
from .common import table

#: The setting that holds the key of the surrogates, and the key of tests.
PII_KEY = ("spark.tallymark.pii.key", "tallymark")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.digests(token_files.written_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), packed=True))


def bpe_digests(docs: DataFrame) -> DataFrame:
    whole = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return whole.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("redacted")


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), spark.conf.get(*PII_KEY))


def op11_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.window_algebra(table(spark, sf_dir, "clicks"), "kind", "ts", "client_id")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.grafted_trie(table(spark, sf_dir, "conversations"))


def prefix_bpe_digests(docs: DataFrame) -> DataFrame:
    whole = prefix_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return whole.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_files, op2_bpe, op3_spans, op4_neighbours, op5_secrets, op6_contamination, op7_quality, op8_simhash, op9_lm, op10_pii, op11_distinct, op12_trie, op13_prefix_bpe)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_contamination": contamination.SQL, "op12_trie": trie.SQL}
