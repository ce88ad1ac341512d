from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from haulwise.llm import lexical
from haulwise.llm.collocations import END, mine_collocations, multikey_runs, pieces
from haulwise.llm.lexical import build_index, search
from haulwise.llm.piece_counts import PieceCounter, count_pieces, piece_counter
from haulwise.llm.token_queries import tokenizer_file
from tests.llm.cases import LONG, TEXTS, awkward, nothing, plain_words

MODEL = tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", "\na", "a\nb", "a \n b", "a▁b", "▁", "▁▁a", "<s>", "\x00a", "a\tb", "日本語 text\r\nx", "é é", "x" * 5000]


# Token counts

def library(text):
    return len(piece_counter(MODEL).model.encode(text or ""))


def test_sum_over_pre_tokens_is_the_library_count():
    counter = PieceCounter(MODEL)
    assert counter.cuts
    random.seed(3)
    made = ["".join(random.choices("ab .\n▁é日<s>\t", k=random.randrange(30))) for _ in range(3000)]
    for text in [*ODD, *made]:
        assert counter.count(counter.split(text)).sum() == library(text), repr(text)


@pytest.mark.parametrize("head", [300_000, 5])
def test_every_row_is_counted(spark, head):
    docs = awkward(spark).select("doc_id", "text", "n_bytes", "score").union(
        spark.createDataFrame([(100 + n, t, None, None) for n, t in enumerate(ODD)], "doc_id long, text string, n_bytes string, score string")
    )
    got = count_pieces(docs, MODEL, head=head)
    assert got.columns == ["doc_id", "score", "n_bytes", "n_tokens"]
    expected = collections.Counter((r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == expected
    assert count_pieces(nothing(spark), MODEL).count() == 0


# Ranked lexical search

def ranked_by_hand(docs, items, top=10):
    split = [(doc_id, plain_words(text)) for doc_id, text in docs]
    split = [(doc_id, w) for doc_id, w in split if w]
    all_docs, all_terms = len(split), sum(len(w) for _, w in split)
    df = collections.Counter(term for _, w in split for term in set(w))
    out = []
    for item, text in items:
        scores = []
        for doc_id, w in split:
            tf, m, score = collections.Counter(w), 25 + (75 * len(w) * all_docs) // all_terms, 0
            for term in plain_words(text):
                if tf[term]:
                    score += math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[term] + 1))) * (1000000000 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, rank, doc_id if known else None, -score) for rank, (score, known, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [
    (1, "word1 über5 word1 the LINE"), (2, None), (3, "!!"), (4, "nowhere found"), (5, "solo w1 w2 w3 w3"), (None, "the same line"), (6, "the same line"),
    (6, "plain text of a few words"), (7, " ".join(f"w{n % 50}" for n in range(3000))),
]


@pytest.mark.parametrize("block", [1000, 2])
def test_search_by_hand(spark, block, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", block)
    random.seed(4)
    texts = [" ".join(f"w{min(int(random.expovariate(0.1)), 80)}" for _ in range(random.choice([1, 5, 30, 400]))) for _ in range(300)]
    texts += ["w1 w2 solo copy"] * 40
    docs = awkward(spark).select("doc_id", "text", "score", "path").union(
        spark.createDataFrame([(100 + n, t, None, None) for n, t in enumerate(texts)], "doc_id long, text string, score string, path int")
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = search(build_index(docs), docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    expected = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(build_index(nothing(spark)), nothing(spark), items).count() == 0
    assert search(build_index(awkward(spark)), awkward(spark), items.filter("false")).count() == 0


def test_bounds_are_never_too_low():
    random.seed(6)
    docs = [collections.Counter(random.choices([b"t%d" % n for n in range(40)], k=random.choice([3, 50, 900]))) for _ in range(200)]
    blocks = lexical.Blocks()
    for row, of in enumerate(docs):
        tf = np.array([*of.values()])
        blocks.add(row, int(tf.sum()), lexical.hashes_of(of), lexical._levels(tf))
    all_terms = sum(map(collections.Counter.total, docs))
    items = [lexical.Item(n, n, collections.Counter(random.choices([b"t%d" % n for n in range(60)], k=12))) for n in range(20)]
    query = lexical.Query(items, {b"t%d" % n: 100 * n for n in range(60)}, len(docs), all_terms)
    seen, loose = 0, 0
    for ids, lengths, width, slices in blocks.rest():
        for place, bound in query.bounds(np.array(lengths), width, slices):
            for row, most in zip(ids, bound.tolist(), strict=True):
                exact = query.score(docs[row], docs[row].total(), items[place])
                assert most >= exact
                seen, loose = seen + 1, loose + (most > 1.5 * exact + 1)
    assert seen == 20 * 200 and loose < 0.1 * seen


# Collocations

def collocations_by_hand(docs, least=10, longest=3, top=2000):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [
            n for (other, q), n in counts.items()
            if other == lang and len(q) > len(p) and n >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ]
        if not longer or 100 * max(longer) < 50 * a:
            found[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], sizes[lang]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n, -score)
        for lang, rows in found.items() for rank, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:top], 1)
    )


SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, a int, word string, code long, f int"


@pytest.mark.parametrize("longest, buckets, at_once, sent", [(3, 2_000_000, 1_000_000, 2_000_000), (3, 50, 40, 2_000_000), (4, 100, 60, 0)])
def test_collocations_by_hand(spark, longest, buckets, at_once, sent, monkeypatch):
    from haulwise.llm import collocations

    monkeypatch.setattr(collocations, "BUCKET_SUFFIXES", buckets)
    monkeypatch.setattr(collocations, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "SENT_CODES", sent)
    monkeypatch.setattr(collocations, "HEAVY_ONE_IN", 30)
    random.seed(8)
    alphabet = ["the", "of", "The", "é", "x\x00y", "a", "b", "c", "d|", "　z"]
    rows = [
        (n, "".join(random.choice(alphabet) + random.choice([" ", "  ", "\t", ". ", "\n", ",", "!"][: random.choice([3, 7])]) for _ in range(40)), random.choice(["en", "de", None, "und", ""]))
        for n in range(60)
    ] + [(200, "of the of the of the a", "en")] * 30 + [(None, None, "en"), (5, "", None), (6, LONG, "fr")] + [(n, t, None) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*row, *[None] * 6) for row in rows], SCHEMA)
    got = mine_collocations(docs, longest=longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations_by_hand([(lang, text) for _, text, lang in rows], longest=longest)
    assert sorted(tuple(r) for r in mine_collocations(docs, top=3).filter("lang = 'en'").collect()) == [
        row for row in collocations_by_hand([(lang, text) for _, text, lang in rows], top=3) if row[0] == "en"
    ]


def test_collocations_of_nothing(spark):
    assert mine_collocations(nothing(spark)).count() == 0
    assert mine_collocations(nothing(spark).selectExpr("*").limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert pieces("A  b.C\td\n") == [b"a", b"b", END, b"c", b"d", END] and pieces(None) == []


def test_partitions_of_the_quicksort_are_counts(monkeypatch):
    from haulwise.llm import collocations

    monkeypatch.setattr(collocations, "SMALL", 20)
    random.seed(9)
    suffixes = [[random.randrange(2, 9) for _ in range(random.randrange(1, 4))] for _ in range(900)]
    keys = [np.array([s[d] if d < len(s) else 0 for s in suffixes], dtype=np.uint64) for d in range(3)]
    weights = np.array([random.randrange(1, 4) for _ in suffixes])
    for least, whole in ((1, 0), (25, 0), (25, 2)):
        expected = collections.Counter()
        for s, weight in zip(suffixes, weights.tolist()):
            for d in range(len(s)):
                expected[tuple(s[: d + 1])] += weight
        expected = {p: n for p, n in expected.items() if n >= least or len(p) <= whole}
        found = {}
        for depth, at, sums in multikey_runs(keys, weights, least, whole):
            for pointer, total in zip(at.tolist(), sums.tolist(), strict=True):
                phrase = tuple(int(keys[d][pointer]) for d in range(depth + 1))
                assert phrase not in found
                found[phrase] = total
        # A longer phrase of a partition that was kept only as a whole is given if its own count is enough.
        assert found == expected
    assert not list(itertools.chain(multikey_runs([np.zeros(0, dtype=np.uint64)] * 3, np.zeros(0, dtype=np.int64), 1)))
