from __future__ import annotations

import collections
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from haulwise.llm.packing import Limits, Packer, pack
from haulwise.llm.token_files import lookup, read_token_files, with_checksums, write_token_files
from haulwise.llm.token_queries import tokenizer_file
from haulwise.llm.tokens import encoder
from tests.llm.cases import awkward, nothing

FILE = tokenizer_file()
ODD = [
    "a<|startoftext|>b İΣΑΣ é ́x it's I'LL 'S\u0085q \x1cz w  don't12\t\r\n", "'s 't", "ﬁ ß ΑΣ", "ÉÀ's__x--'t'T a_b 1²", "", "\n",
    "x’s «É» ÿŸ“”…¿¡ ª", "O'Neil's I'VE'd'd 'll'", "日本語 text", "é é", "123 4,5.6", "<|endoftext|>",
]


def whole(text):
    return np.array(encoder(FILE).whole.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_fast_way_gives_the_library_ids():
    assert encoder(FILE).by_word
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder(FILE)(ODD)] == [whole(text).tolist() for text in ODD]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbZéÉßœ'’sStT019.,_-<|>\n\t «²İ́", max_size=40))
def test_fast_way_on_any_text(text):
    assert np.frombuffer(encoder(FILE)([text])[0], "<u4").tolist() == whole(text).tolist()


def test_other_tokenizer_files_go_through_the_library():
    other = encoder(tokenizer_file("byte_bpe_50k.json"))
    assert not other.by_word
    assert np.frombuffer(other(["Hi there"])[0], "<u4").tolist() == other.whole.encode("Hi there", add_special_tokens=False).ids


def test_files_hold_every_row_in_order(spark, folder):
    docs = awkward(spark)
    write_token_files(docs, f"{folder}/ids", FILE)
    got = [r for r in read_token_files(spark, f"{folder}/ids").orderBy("start").collect()]
    at, last = 0, -1
    for row in got:
        assert row.start == at and row.n_tokens == len(row.tokens) and row.tokens[-1] == 1
        assert (row.doc_id if row.doc_id is not None else -1) >= last
        at, last = at + row.n_tokens, row.doc_id if row.doc_id is not None else -1
    expected = collections.Counter((r.doc_id, (*whole(r.text).tolist(), 1)) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.tokens)) for r in got) == expected
    assert [r.ids_crc32 for r in with_checksums(read_token_files(spark, f"{folder}/ids")).orderBy("start").collect()] == [
        zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in got
    ]
    found = lookup(spark, f"{folder}/ids", [3])
    assert found.count() == 2
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id" in found._jdf.queryExecution().toString()


def test_empty_table(spark, folder):
    write_token_files(nothing(spark), f"{folder}/ids", FILE)
    assert read_token_files(spark, f"{folder}/ids").count() == 0
    assert pack(nothing(spark), FILE).count() == 0


def check_pieces(rows, lengths, limits, padding_ok):
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        of[row[0]].append(row)
        sequences[row[3]].append(row)
    for name, (length, _) in lengths.items():
        at = 0
        for row in sorted(of[name], key=lambda r: r[1]):
            assert row[1] == at
            at += row[2]
        assert at == length
    for pieces in sequences.values():
        at = 0
        for row in sorted(pieces, key=lambda r: r[4]):
            assert row[4] == at and row[2] > 0
            at += row[2]
        loss = sum(max(0, start + n - max(start, lengths[name][1])) for name, start, n, _, _ in pieces)
        assert at <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss_tokens
    padding = sum(0 if n & (n - 1) == 0 else limits.tokens - n for n in (sum(r[2] for r in p) for p in sequences.values()))
    assert not padding_ok or padding <= padding_ok


def test_packer_keeps_all_limits():
    random.seed(5)
    for cut, limits in ((True, Limits(64, 8, 64)), (True, Limits(64, 3, 40)), (False, Limits(64, 4, 30)), (False, Limits(64, 2, 64))):
        lengths = {n: (size := random.choice([1, 2, 5, 30, 63, 64, 65, 200]), random.choice([0, 0, 3, size])) for n in range(400)}
        rows = []
        packer = Packer(limits, cut, lambda *row, out=rows: out.append(row), pool=50)
        for name, (length, first) in lengths.items():
            packer.add(name, length, first)
        packer.finish()
        check_pieces(rows, lengths, limits, 0 if limits != Limits(64, 8, 64) else 200)


def test_pack_awkward_rows(spark):
    docs = awkward(spark)
    rows = pack(docs, FILE, loss_from="n_chars", with_tokens=True).collect()
    assert sum(r.length for r in rows) == sum(len(whole(r.text)) + 1 for r in docs.collect())
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) and len(r.tokens) == r.length for r in rows)
    assert {r.doc_id for r in rows} == {*range(10), None}
    assert pack(docs, FILE, Limits(4096, 1, 4096)).groupBy("sequence_id").count().agg({"count": "max"}).first()[0] == 1
