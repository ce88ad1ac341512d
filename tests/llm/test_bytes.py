from __future__ import annotations

import collections
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from haulwise.llm import warc
from haulwise.llm.transport import PES_BYTES, demux, mux, padded, read_streams, to_streams
from tests.llm.cases import awkward, nothing


# Web archives

PAGES = [
    (5, "http://a.example/x y\r\nEvil: 1", "<p>same</p>"), (3, "http://b.example/é", "<p>same</p>"), (4, None, "<p>same</p>"), (4, None, "<p>same</p>"), (3, "", "<p>same</p>"),
    (9, "http://c.example", None), (8, "http://c.example", ""), (None, "http://d.example", "<p>same</p>"), (None, "u", "only"), (None, "u", "only"),
    (10, "http://e.example", "long " * 60_000), (11, "u", "\r\n\r\nWARC/1.1\r\n"),
]


def pages(spark):
    extra = "payload int, digest int, _payload int, _key string, file int, offset int, _first int"
    return spark.createDataFrame([(*row, *[None] * 7) for row in PAGES], f"page_id long, url string, html string, {extra}").repartition(3)


def pages_by_hand(least=0):
    smallest = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            smallest[html or ""] = min(page_id, smallest.get(html or "", page_id))
    out = collections.Counter()
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        first = smallest.get(html or "")
        revisit = first is not None and page_id != first and len(body) >= least
        out[page_id, "revisit" if revisit else "response", warc.digest(body), len(body), first if revisit else None] += 1
    return out


def found(rows):
    return collections.Counter((r.page_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to) for r in rows)


@pytest.mark.parametrize("options", [{}, {"min_revisit_bytes": 5}, {"file_bytes": 600}])
def test_archives_round_trip(spark, folder, options):
    index = warc.write_archives(pages(spark), f"{folder}/a", **options)
    rows = warc.read_records(index, f"{folder}/a").collect()
    assert found(rows) == pages_by_hand(options.get("min_revisit_bytes", 0))
    for row in rows:
        assert (row.payload is None) == (row.record_type == "revisit")
        assert row.payload is None or hashlib.sha1(row.payload).hexdigest() and warc.digest(bytes(row.payload)) == row.payload_digest
    some = index.filter("page_id IN ('8', '10')")
    assert {r.page_id for r in warc.read_records(some, f"{folder}/a", with_payload=False).collect()} == {8, 10}
    places = [(r.file, r.offset, r.length) for r in index.orderBy("file", "offset").collect()]
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_archives_are_valid_files(spark, folder):
    index = warc.write_archives(pages(spark).coalesce(1), f"{folder}/a").collect()
    whole = b"".join(gzip.open(f"{folder}/a/{name}").read() for name in sorted({r.file for r in index}))
    heads = [r for r in whole.split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    assert len(heads) == len(PAGES) and not any(b"\r\nEvil" in head.partition(b"\r\n\r\n")[0] for head in heads)
    record = warc.to_record("1", "u", b"abc", warc.digest(b"abc"), None, False, warc.DATE)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(gzip.decompress(record).replace(b"abc", b"abd")))
    with pytest.raises((ValueError, EOFError, zlib.error)):
        warc.parse_record(record[:-20])


def test_archives_of_nothing(spark, folder):
    index = warc.write_archives(pages(spark).filter("false"), f"{folder}/a")
    assert index.count() == 0 and warc.read_records(index, f"{folder}/a").count() == 0


# Transport streams

def test_streams_of_all_sizes():
    rng = random.Random(1)
    sizes = [*range(1, 800, 7), *(PES_BYTES * k + d for k in (1, 4, 5) for d in (-200, -8, -1, 0, 1, 100, 161, 162, 163, 169, 170, 171))]
    for size in sizes:
        payload = rng.randbytes(size)
        stream = demux(mux(payload))
        assert stream.payload == payload and stream.counter_errors == 0
        assert stream.stamps == [3600 * n for n in range(len(stream.stamps))] and len(stream.random_access) == -(-len(stream.stamps) // 4)


def test_damage_is_found():
    raw = bytearray(mux(random.Random(2).randbytes(3000)))
    for broken in (raw[: 188 * 5] + raw[188 * 6 :], raw[:-188], b"\0" + raw[1:], raw[:10] + b"\xff" + raw[11:], raw[188 * 2 :], raw[:100]):
        with pytest.raises((ValueError, IndexError)):
            demux(bytes(broken))
    twice = demux(bytes(raw) + bytes(mux(b"x" * 64))[188 * 2 :])  # a second packet whose counter starts again
    assert twice.counter_errors == 1


def test_awkward_texts_as_streams(spark):
    docs = awkward(spark)
    got = read_streams(to_streams(docs)).collect()
    expected = collections.Counter()
    for row in docs.collect():
        payload = padded(row.text)
        expected[row.doc_id, len((row.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
        assert len(payload) % 64 == 0 and len(payload) >= 64
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == expected
    assert len({r.feature for r in got if not r.text}) == 1
    assert read_streams(to_streams(nothing(spark))).count() == 0
    with pytest.raises(Exception, match="index does not belong"):
        read_streams(to_streams(docs).withColumn("stamps", F.array(F.lit(7).cast("long")))).count()


def test_ids_of_any_characters_and_enough_readers(spark, folder):
    ids = ["a\r\nWARC-Type: revisit", "a", "é: %0A", "", "x y", None]
    pages = spark.createDataFrame([(i, "http://x/", f"page {n % 4}" * 50) for n, i in enumerate(ids)], "page_id string, url string, html string")
    index = warc.write_archives(pages, f"{folder}/warc")
    got = warc.read_records(index, f"{folder}/warc", id_type="string").collect()
    assert sorted((r.page_id for r in got), key=repr) == sorted(ids, key=repr)
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {r.page_id: (r.record_type, r.refers_to) for r in index.collect()}
    large = index.withColumn("length", F.lit(3 * warc.STRETCH_BYTES).cast("long"))
    assert warc.read_records(large, f"{folder}/warc").rdd.getNumPartitions() >= 3 * len(ids)
