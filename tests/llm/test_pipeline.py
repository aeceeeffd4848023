"""The pipeline against brute force, stage by stage, and as run() chains it."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import INTERNAL, LONG, ODD, brute_contamination, brute_near, crowded, expected_bpe, pairs

from tallymark.llm import near_copies, quality, secrets

DIGESTS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def expected(docs, benchmark, accepted):
    """What the stages after the classifier make of the accepted documents; ids are distinct."""
    texts = [(i, t) for i, t in docs if i in accepted]
    classes = brute_near(texts)
    texts = [(i, t) for i, t in texts if classes[i] == i]
    dirty = {r[0] for r in brute_contamination(texts, benchmark) if r[-1]}
    clean = [(i, t and secrets.redact(t, secrets.base_spans(t) + secrets.entropy_spans(t))) for i, t in texts if i not in dirty]
    return expected_bpe(clean)


def test_pipeline_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    accepted = {r.doc_id for r in scored.where("keep").collect()}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert 0 < len(accepted) < len(rows)
    assert pairs(corpus_pipeline.run(spark, sf), *DIGESTS) == expected(rows, benchmark, accepted)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


@pytest.fixture
def folder(spark, tmp_path):
    def made(rows, labels=((1, 1, 0),), items=((1, "not in there"),)):
        crowded(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
        return f"file://{tmp_path}"

    return made


def test_pipeline_odd(spark, folder):
    """Nulls, ties, long texts and clashing columns; one row of copies stays, and every row without an id."""
    path = folder(LONG + ODD)
    got = [r.doc_id for r in corpus_pipeline.run(spark, path).collect()]
    assert got.count(None) == 1 and got.count(4) == 1 and set(got) <= {i for i, _ in LONG + ODD} | {None}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == ["doc_id", "text", "lang", "source", "n_chars", *INTERNAL]


def test_pipeline_empty(spark, folder, tmp_path):
    path = folder([(1, "a")])
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_near_duplicates_exact(spark, sf):
    """A document goes only if its five-word shingles, those of an earlier one, or a chain of such, are alike by 0.8."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, (r.text or "").lower().split()) for r in docs.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for _, w in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    least = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    want = [i for (i, _), own, at in zip(rows, least, range(len(rows)), strict=True) if own == at]
    assert len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == want
