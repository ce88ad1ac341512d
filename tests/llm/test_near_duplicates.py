from __future__ import annotations

import collections
import itertools
import random

import numpy as np
from fractions import Fraction
import pytest
from pyspark.sql import functions as F

from haulwise.llm.near_duplicates import find_near_duplicates, keep_one_per_class, links_between, prefix_length
from tests.llm.cases import awkward, nothing, plain_words


def grams(text):
    split = plain_words(text)
    size = min(5, len(split))
    return frozenset(tuple(split[i : i + size]) for i in range(len(split) - size + 1)) if size else frozenset()


def by_hand(rows):
    """(class id, links) of each row by comparing all pairs."""
    sets = [grams(text) for _, text in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (10 * len(a & b) >= 8 * len(a | b)) if a and b else not a and not b and (rows[i][1] or "") == (rows[j][1] or ""):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(doc_id, smallest[find(i)], links[i]) for i, (doc_id, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(60)], []
    for size in (8, 40, 200):
        base = [word() for _ in range(size)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 20)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *[word() for _ in range(rng.randrange(10, 200))]]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(60)] + texts[:15]
    rng.shuffle(texts)
    return list(enumerate(texts, 1000))


@pytest.mark.parametrize("block_weight", [1_000_000, 4000])
def test_classes_and_links_by_hand(spark, block_weight):
    docs = awkward(spark).select("doc_id", "text", "rep", "component", "one", "block").union(
        spark.createDataFrame([(*row, "", 0, 0, 0) for row in corpus()], "doc_id long, text string, rep string, component int, one int, block int")
    ).repartition(6)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, roots = by_hand(rows)
    got = [(r.doc_id, r.class_id, r.n_links) for r in find_near_duplicates(docs, block_weight=block_weight).collect()]
    assert collections.Counter(got) == collections.Counter(expected)
    if block_weight > 4000:
        kept = keep_one_per_class(docs).collect()
        of = {}
        for row, root in zip(rows, roots, strict=True):
            of.setdefault(root, []).append((row[0] is None, row[0] or 0))
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(members) for members in of.values())
        assert kept[0].__fields__ == docs.columns


def test_popular_prefixes_do_not_multiply(spark):
    """A large group of near copies costs candidates in proportion to its size."""
    from haulwise.llm import near_duplicates as m

    rng, base = random.Random(9), [f"b{n}" for n in range(150)]
    rows = []
    for n in range(600):
        copy = list(base)
        copy[rng.randrange(150)] = f"own{n}"
        rows.append((n, " ".join(copy)))
    docs = m._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id", "text")
    reps = m.written(m._signed(docs, 5, m.TREES, m.DEPTH, 6).withColumn("rep", F.col("doc_id")), "reps")
    assert m._neighbours(reps).count() <= 600 * m.TREES
    got = find_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.min("n_links"), F.max("class_id")).first()[:] == (599, 0)


def test_nothing(spark):
    assert find_near_duplicates(nothing(spark)).count() == 0 and keep_one_per_class(nothing(spark)).count() == 0


def test_recall_of_prefixes():
    assert prefix_length(0.8, 32, 8, 0.9999) == 6
    assert 1 - (1 - 0.8**6) ** 32 >= 0.9999 > 1 - (1 - 0.8**7) ** 32


def test_links_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.int64)) for _ in range(80)]
    found = links_between(sets[:30], sets[30:], Fraction(4, 5))
    for i, a in enumerate(sets[:30]):
        for j, b in enumerate(sets[30:]):
            both = len(np.intersect1d(a, b))
            assert found[i, j] == (5 * both >= 4 * (len(a) + len(b) - both))
    same = np.array([4, 5, 6, 7, 8])
    assert links_between([same[:4]], [same], Fraction(4, 5))[0, 0] and not links_between([same[:3]], [same[:4]], Fraction(4, 5))[0, 0]


@pytest.mark.parametrize("run_block", [1024, 100])
def test_pairs_of_a_passage_family(spark, run_block):
    """Documents that are mostly one passage share prefixes but are no near duplicates; the few true pairs among them are found."""
    from haulwise.llm.near_duplicates import Grams

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(104)]
    # 100 n-grams of the passage and 12 (3 documents, pairwise 100 / 124) or 50 more (at most 100 / 162 with any other).
    texts = [" ".join([*passage, *[word() for _ in range(own)]]) for own in [12] * 3 + [50] * 2500]
    rng.shuffle(texts)
    sets, expected = [Grams(5)(text) for text in texts], collections.Counter()
    for start in range(0, len(sets), 500):
        for at, row in enumerate(links_between(sets[start : start + 500], sets, Fraction(4, 5)), start):
            expected[at] = int(row.sum()) - 1
    assert sum(expected.values()) == 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.n_links for r in find_near_duplicates(docs, run_block=run_block).collect()} == dict(expected)


def test_agreements_of_blocks():
    from haulwise.llm.near_duplicates import agreements

    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 3, (70, 256)).astype(np.uint8), rng.integers(0, 3, (90, 256)).astype(np.uint8)
    right[4] = left[3]
    expected = (left[:, None] == right).sum(axis=2)
    assert (agreements(left, right) == expected).all() and (agreements(left[:9], right[:9]) == expected[:9, :9]).all() and expected[3, 4] == 256
