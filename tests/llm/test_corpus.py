from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulwise.llm.decontamination import find_contamination, merged
from haulwise.llm.line_dedup import Bits, drop_repeated_lines, line_keys
from haulwise.llm.quality import fit_quality, fit_trees, score_quality, statistics
from tests.conftest import SMALLEST
from tests.llm.cases import LONG, awkward, documents, nothing, plain_words


# Benchmark decontamination

ITEMS = [
    (1, " ".join(f"w{n}" for n in range(20))), (2, "One short item"), (3, "solo"), (4, None), (5, "!!"), (6, "ONE short, item"), (None, "plain"), (7, "word5 über5"),
    (8, " ".join(f"W{n}" for n in range(5, 18))),
]


def by_hand(text, items):
    """(words, hit words, items) by comparing every window with every place."""
    split, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        theirs = plain_words(item_text)
        size = min(13, len(theirs))
        wins = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for at in range(len(split) - size + 1):
            if tuple(split[at : at + size]) in wins:
                hit.update(range(at, at + size))
                if item is not None:
                    found.add(str(item))
    return len(split), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_contamination_by_hand(spark, block_bytes):
    texts = [
        " ".join(f"w{n}" for n in range(3, 18)) + " x " + " ".join(f"w{n}" for n in range(7, 20)), "a one SHORT item b", "solo solo", "w1 w2", LONG, None, "",
        " ".join(f"w{n}" for n in [*range(20), *range(20)]), "one short one short item item",
    ]
    docs = awkward(spark).select("doc_id", "text", "n_words", "hits", "_hits").union(
        spark.createDataFrame([(100 + n, t, 1, 1, 1) for n, t in enumerate(texts)], "doc_id long, text string, n_words int, hits int, _hits int")
    )
    found = find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert len(found) == docs.count()
    for row in found:
        n, hit, items = by_hand(row.text, ITEMS)
        assert (row.n_words, row.n_hit, row.n_items, row["items"]) == (n, hit, len(items), items)
        assert row.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(s.after - s["first"] for s in row.hit_spans) == hit


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(nothing(spark), items).count() == 0
    clean = find_contamination(awkward(spark), items.filter("false"))
    assert clean.filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and clean.count() == awkward(spark).count()
    assert merged([(5, 9), (1, 3), (3, 4), (6, 7)]) == [(1, 4), (5, 9)]


# Line dedup

def lines_by_hand(rows, least, keep_first=False):
    seen, first = collections.Counter(), {}
    for doc_id, text in rows:
        for number, key in enumerate(line_keys(text)):
            place = (doc_id is not None, doc_id or 0, number)
            first[key] = min(first.get(key, place), place)
        seen.update({key for key in line_keys(text) if key})
    out = []
    for doc_id, text in rows:
        kept = [
            line for number, (key, line) in enumerate(zip(line_keys(text), (text or "").split("\n")))
            if seen[key] < least or keep_first and first[key] == (doc_id is not None, doc_id or 0, number)
        ]
        out.append((doc_id, len(line_keys(text)), len(line_keys(text)) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}, {"filter_bits": 8}, {"keep_first": True}, {"keep_first": True, "broadcast_bytes": -1}])
def test_repeated_lines_by_hand(spark, options):
    texts = [(n, f"own {n}\n\tShared LINE \n{'twice' if n < 2 else n}\n") for n in range(12)] + [(20, "own 3\nshared line\nshared line"), (21, "é\n" * 3), (22, "\x85x")]
    docs = awkward(spark).select("doc_id", "text", "line", "kept_text").union(
        spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "doc_id long, text string, line int, kept_text int")
    ).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = drop_repeated_lines(docs, min_documents=3, **options).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == lines_by_hand(rows, 3, options.get("keep_first", False))


def test_lines_of_nothing(spark):
    assert drop_repeated_lines(nothing(spark)).count() == 0


def test_filter_never_forgets():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = Bits(1 << 16)
    bits.add(hashes[:2500])
    assert bits.has(hashes[:2500]).all() and bits.has(hashes[2500:]).mean() < 0.05


# Quality

def test_quality_of_held_out_documents(spark):
    folder = SMALLEST.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert right[0] >= 0.95 and right[1] > 50


def test_awkward_rows_and_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(10)] + [(0, 1, 0), (None, 1, 0), (2, None, 0), (4, 7, 1)], "doc_id long, quality int, toxic int")
    trees = fit_quality(docs, labels)
    scored = score_quality(docs, trees).collect()
    by_text = collections.defaultdict(set)
    for row in scored:
        by_text[row.text or ""].add(row.score)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
    assert len(scored) == docs.count() and all(len(scores) == 1 for scores in by_text.values())
    assert score_quality(nothing(spark), trees).count() == 0
    # Without labels there is no ground for rejecting anything.
    nothing_known = fit_quality(docs, labels.filter("false"))
    assert score_quality(docs, nothing_known).filter("predicted = 0").count() == 0
    assert fit_quality(docs, labels, max_labelled=2).feature.shape == trees.feature.shape


def test_trees_split_what_can_be_split():
    rng = np.random.default_rng(2)
    rows = rng.random((800, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = fit_trees(rows, labels)
    assert ((trees.scores(rows) > 0.5) == labels).mean() > 0.98
    walked = []
    for row in rows[:50]:
        total = trees.base
        for tree in range(len(trees.leaf)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[tree, node]] > trees.threshold[tree, node])
            total += trees.leaf[tree, node - trees.feature.shape[1]]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, trees.scores(rows[:50]))
    assert statistics(None) == statistics("") == statistics(" \n") and len(set(map(len, (statistics(""), statistics("a b"))))) == 1


def test_labels_are_never_learned_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALLEST}/{name}.parquet") for name in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = fit_quality(docs, labels), fit_quality(docs, turned)
    assert np.array_equal(one.leaf, other.leaf) and np.array_equal(one.threshold, other.threshold)


def test_sha_of_kept_text_is_that_of_the_lines(spark):
    kept = drop_repeated_lines(spark.read.parquet(f"{SMALLEST}/documents.parquet")).collect()
    expected = lines_by_hand([(k, r.text) for k, r in documents(spark, SMALLEST).items()], 10)
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).digest()) for r in kept) == collections.Counter(
        (i, n, d, hashlib.sha256(t.encode()).digest()) for i, n, d, t in expected
    )
