"""Every stage of the pipeline against plain Python, over the smallest tables and over awkward rows."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haulwise.llm.quality import fit_quality, score_quality
from tests.conftest import SMALLEST
from tests.llm.cases import awkward
from tests.llm.test_corpus import by_hand as contamination_by_hand, lines_by_hand
from tests.llm.test_near_duplicates import by_hand as classes_by_hand
from tests.llm.test_tokens import whole


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    columns = docs.columns
    kept = stage("quality")(spark, docs, SMALLEST).cache()
    rejected = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{SMALLEST}/labels.parquet"))).filter("predicted = 0").select(*columns)
    assert kept.columns == columns
    assert collections.Counter(kept.collect()) + collections.Counter(rejected.collect()) == collections.Counter(docs.collect())
    labelled = kept.join(spark.read.parquet(f"{SMALLEST}/labels.parquet"), "doc_id").agg(F.avg("quality")).first()[0]
    assert labelled > 0.95

    cleaned = stage("lines")(spark, kept, SMALLEST).cache()
    assert cleaned.columns == columns
    expected = lines_by_hand([(r.doc_id, r.text) for r in kept.collect()], 10)
    assert {(r.doc_id, r.text) for r in cleaned.collect()} == {(i, text) for i, _, _, text in expected}
    assert cleaned.filter("n_chars != char_length(text)").count() == 0

    unique = stage("near_duplicates")(spark, cleaned, SMALLEST).cache()
    rows = [(r.doc_id, r.text) for r in cleaned.collect()]
    classes, _ = classes_by_hand(rows)
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == {class_id for _, class_id, _ in classes}

    clean = stage("decontamination")(spark, unique, SMALLEST).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    spared = set()
    for row in unique.collect():
        n, hit, _ = contamination_by_hand(row.text, items)
        if not (hit > 0 and 20 * hit >= n):
            spared.add(row.doc_id)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == spared

    pieces = stage("packing")(spark, clean, SMALLEST).collect()
    tokens = collections.Counter()
    for row in pieces:
        tokens[row.doc_id] += row.length
    assert tokens == {r.doc_id: len(whole(r.text)) + 1 for r in clean.collect()}
    for df in (kept, cleaned, unique, clean):
        df.unpersist()


def test_run_is_all_stages(spark):
    pieces = corpus_pipeline.run(spark, SMALLEST)
    assert pieces.count() > 0 and pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, empty):
    docs = awkward(spark)
    docs = docs.filter("false") if empty else docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SMALLEST)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= docs.count()
    assert {r.doc_id for r in stage("packing")(spark, docs, SMALLEST).collect()} == (set() if empty else {*range(10), None})
