"""Lines that repeat across documents, found with two Bloom filters and confirmed exactly.

1. Every task keeps two filters of a fixed size: hashes of lines seen once and of lines seen at least twice (copies within one
   document count once). The filters of all tasks are merged segment by segment: twice is the union of all "twice" and of
   everything that two "once" filters share.
2. Only lines that the merged "twice" filter suspects are shuffled, counted by their whole text (partial sums first, so a line
   on every page ships one row per task) and kept if enough documents have them. A false suspicion costs a row, never a result;
   a filter too small for the corpus only suspects more.
3. The confirmed lines are dropped where the documents are read if their measured size allows a broadcast, else by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.columns import append_columns, without
from haulwise.session import cut_and_measure

MIN_DOCUMENTS = 10
# Bits of one filter: 16 MB, good for some thirty million different lines; above that more lines are shuffled.
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 16
BROADCAST_BYTES = 16 << 20
# What a line costs in a Python set besides its bytes.
BYTES_PER_LINE = 120
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line of a text: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANKS).lower() for line in (text or "").encode().split(b"\n")]


def _counted(key: bytes, min_chars: int) -> bool:
    return bool(key) and (min_chars <= 1 or len(key.decode()) >= min_chars)


class Bits:
    """A Bloom filter of two bits per 64-bit hash."""

    def __init__(self, bits: int) -> None:
        self.mask, self.bytes = np.uint64(bits - 1), np.zeros(bits // 8, dtype=np.uint8)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.mask, (hashes >> np.uint64(32)) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for place in self._places(hashes):
            np.bitwise_or.at(self.bytes, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        first, second = (
            self.bytes[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 for place in self._places(hashes)
        )
        return (first & second).astype(bool)


def _pack(segment: np.ndarray) -> bytes:
    """A segment as its set places (two bytes each) where that is shorter than its bytes."""
    some = np.flatnonzero(segment)
    if 8 * len(some) < len(segment):
        rows, columns = np.nonzero(np.unpackbits(segment[some, None], axis=1, bitorder="little"))
        places = (some[rows] * 8 + columns).astype("<u2")
        if 2 * len(places) < len(segment):
            return places.tobytes()
    return segment.tobytes()


def _unpack(packed: bytes, size: int) -> np.ndarray:
    if len(packed) == size:
        return np.frombuffer(packed, dtype=np.uint8)
    segment, places = np.zeros(size, dtype=np.uint8), np.frombuffer(packed, dtype="<u2").astype(np.int64)
    np.bitwise_or.at(segment, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return segment


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(key) for key in keys), dtype=np.uint64)


def _twice_seen(docs: DataFrame, text: str, min_chars: int, bits: int) -> dict[int, bytes]:
    """The merged "twice" filter by segment: at most ``bits`` bits in all, whatever the corpus."""
    size = min(bits, SEGMENT_BITS) // 8

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bits(bits), Bits(bits)
        for batch in batches:
            keys = (key for one in batch.column(0).to_pylist() for key in {k for k in line_keys(one) if _counted(k, min_chars)})
            hashes, counts = np.unique(_hashes(keys), return_counts=True)
            twice.add(hashes[once.has(hashes) | (counts > 1)])
            once.add(hashes)
        ones, twos = once.bytes.reshape(-1, size), twice.bytes.reshape(-1, size)
        used = np.flatnonzero(ones.any(axis=1)).tolist()
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([_pack(ones[s]) for s in part], pa.binary()), pa.array([_pack(twos[s]) for s in part], pa.binary())],
                names=["segment", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for segment, more_once, more_twice in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if segment != current:
                    if current is not None and twice.any():
                        yield result()
                    current, once, twice = segment, np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
                other = _unpack(more_once, size)
                twice |= _unpack(more_twice, size) | (once & other)
                once |= other
        if current is not None and twice.any():
            yield result()

    parts = docs.select(text).mapInArrow(seen, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    return {row.segment: bytes(row.twice) for row in merged.toLocalIterator()}


def _suspects(docs: DataFrame, tag: str, text: str, min_chars: int, bits: int, sent: Broadcast) -> DataFrame:
    """(tag, line, line_no): the first line with each suspected key of each document."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bits(bits)
        size = min(bits, SEGMENT_BITS) // 8
        for segment, content in sent.value.items():
            twice.bytes[segment * size : (segment + 1) * size] = np.frombuffer(content, dtype=np.uint8)
        for batch in batches:
            rows, keys, numbers = [], [], []
            for row, one in enumerate(batch.column(1).to_pylist()):
                first: dict[bytes, int] = {}
                for number, key in enumerate(line_keys(one)):
                    if key not in first and _counted(key, min_chars):
                        first[key] = number
                rows += [row] * len(first)
                keys += first.keys()
                numbers += first.values()
            chosen = np.flatnonzero(twice.has(_hashes(keys)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(rows, dtype=np.int64)[chosen])),
                    pa.array([keys[i].decode() for i in chosen.tolist()], pa.string()), pa.array(np.array(numbers, dtype=np.int64)[chosen]),
                ],
                names=["tag", "line", "line_no"],
            )

    kind = docs.schema[tag].dataType.simpleString()
    return docs.select(tag, text).mapInArrow(pick, f"tag {kind}, line string, line_no bigint")


def _kept(text: str | None, tag, frequent: dict[bytes, tuple | None]) -> tuple[int, int, str]:
    """(lines, dropped lines, remaining text); ``frequent`` has the place (tag, line) that may stay, or None."""
    keys, kept, n = line_keys(text), [], 0
    for number, (key, line) in enumerate(zip(keys, (text or "").split("\n"), strict=True)):
        if key in frequent and (frequent[key] is None or frequent[key] != (tag, number)):
            n += 1
        else:
            kept.append(line)
    return len(keys), n, "\n".join(kept)


def _arrays(rows: list[tuple[int, int, str]]) -> list[pa.Array]:
    lines, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_documents: int = MIN_DOCUMENTS, min_chars: int = 1, keep_first: bool = False,
    filter_bits: int = FILTER_BITS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` plus n_lines, n_dropped and kept_text, the text less every line that ``min_documents`` rows or more have.

    A line is compared by its key: blanks (space, \\t to \\r) stripped at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` characters, so empty lines, always stay. A NULL or empty text is one empty line and gives an empty
    kept_text. Each row counts as a document, repeated rows and rows with NULL ids too. ``keep_first`` leaves the first
    occurrence of each such line, by id, then line number; rows that share that id all keep it. An empty table gives an
    empty table; input columns named like a result are replaced.
    """
    spark = docs.sparkSession
    bits = max(1 << 13, 1 << (filter_bits - 1).bit_length())
    if bits > 1 << 32:
        raise ValueError("a filter has at most 2**32 bits")
    sent = spark.sparkContext.broadcast(_twice_seen(docs, text, min_chars, bits))
    counted = (
        _suspects(docs, id_column, text, min_chars, bits, sent).groupBy("line")
        .agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("tag", "line_no")).alias("first")).filter(F.col("documents") >= min_documents)
    )
    zero = F.lit(0).cast("long")
    frequent, measured = cut_and_measure(
        counted, n=F.count(F.lit(1)), size=F.coalesce(F.sum(F.octet_length("line")).cast("long"), zero)
    )
    fields = "n_lines long, n_dropped long, kept_text string"
    if measured["size"] + BYTES_PER_LINE * measured["n"] <= broadcast_bytes:
        lines = spark.sparkContext.broadcast({
            row.line.encode(): (row.first.tag, row.first.line_no) if keep_first else None for row in frequent.toLocalIterator()
        })

        def start():
            known = lines.value
            return lambda texts, tags: _arrays([_kept(t, tag, known) for t, tag in zip(texts.to_pylist(), tags.to_pylist(), strict=True)])

        return append_columns(docs, [F.col(text), F.col(id_column)], fields, start)

    # Equal texts have equal lines, so the lines to drop are looked up once per text and joined back by its digest.
    keyed = without(docs, ["_llm_text", "_llm_lines"]).withColumn("_llm_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    of_text = (
        _suspects(keyed, "_llm_text", text, min_chars, bits, sent).withColumnRenamed("line_no", "_at").join(frequent, "line")
        .groupBy(F.col("tag").alias("_llm_text")).agg(F.collect_set(F.struct("line", "first.tag", "first.line_no")).alias("_llm_lines"))
    )

    def start():
        def drop(texts: pa.Array, tags: pa.Array, lines: pa.Array) -> list[pa.Array]:
            return _arrays([
                _kept(t, tag, {x["line"].encode(): (x["tag"], x["line_no"]) if keep_first else None for x in of or ()})
                for t, tag, of in zip(texts.to_pylist(), tags.to_pylist(), lines.to_pylist(), strict=True)
            ])

        return drop

    joined = keyed.join(of_text, "_llm_text", "left")
    return append_columns(joined, [F.col(text), F.col(id_column), F.col("_llm_lines")], fields, start).drop("_llm_text", "_llm_lines")
