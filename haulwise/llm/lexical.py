"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom filter of its terms; a block of documents of about the same number of terms holds the filters bit by
bit: row b of a block is the bitmap of the documents whose filter has bit b. The AND of a term's rows is the bitmap of the
documents that may hold it: all that do, and a few that do not. A term that occurs more than once is entered again at higher
levels (twice, more than 2, 4, 8 times and so on), so that the rows also bound how often it can occur.

A search
1. sums the weights of an item's terms over those bitmaps, level by level, into an upper bound of each document's score;
2. scores the documents of the ten highest bounds exactly, from their texts: the tenth score is what others have to reach;
3. scores exactly every document whose bound reaches it, and ranks them. No other document can be among the ten.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from haulwise.llm.scratch import new_path, written
from haulwise.llm.words import words
from haulwise.operators.hotkeys import first_per_key

TOP = 10
# A filter has 12 to 24 bits per entry and 5 bits set for each.
BITS_PER_ENTRY, HASHES = 12, 5
# Level j holds the terms that occur more than MORE_THAN[j] times; without level j + 1, a term occurs MORE_THAN[j + 1] times at most.
MORE_THAN = (0, 1, 2, 4, 8, 16, 32, 64)
# A block has at most so many documents and bits in all (1 MB), unless eight documents need more.
BLOCK_DOCUMENTS, BLOCK_BITS = 1024, 1 << 23
# Terms that a task counts before it writes them.
TERMS_HELD = 200_000
# Items that are searched at a time.
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 1000, 1 << 20
# Documents to be scored that are sent to the tasks; more are joined by a shuffle.
SENT_ROWS = 200_000
SCALE, LENGTH_SHARE = 1_000_000_000, 75


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the same terms for each level."""
    x = hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """(terms, HASHES): the bits of each term at a level in a filter of ``width`` bits."""
    x = _mixed(hashes, level)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    spread = (low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((spread * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def hashes_of(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64)


def _levels(tf: np.ndarray) -> np.ndarray:
    return np.searchsorted(MORE_THAN, tf, side="left")


class Blocks:
    """Collects documents by number of entries and gives a block out when it is full."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple[object, int, np.ndarray, np.ndarray]]] = {}

    def add(self, doc_id, n: int, hashes: np.ndarray, levels: np.ndarray) -> tuple | None:
        size = max(4, (int(levels.sum()) - 1).bit_length())
        rows = self.held.setdefault(size, [])
        rows.append((doc_id, n, hashes, levels))
        if len(rows) == min(BLOCK_DOCUMENTS, max(8, BLOCK_BITS // (BITS_PER_ENTRY << size))):
            return self._sliced(size)
        return None

    def rest(self) -> Iterator[tuple]:
        for size in [*self.held]:
            yield self._sliced(size)

    def _sliced(self, size: int) -> tuple:
        """(ids, lengths, width, bit slices) of all documents of one size."""
        rows, width = self.held.pop(size), BITS_PER_ENTRY << size
        bits = np.zeros((width, (len(rows) + 7) // 8), dtype=np.uint8)
        for row, (_, _, hashes, levels) in enumerate(rows):
            for level in range(int(levels.max())):
                bits[places(hashes[levels > level], level, width).ravel(), row >> 3] |= np.uint8(1 << (row & 7))
        return [row[0] for row in rows], [row[1] for row in rows], width, bits.tobytes()


@dataclass(frozen=True)
class Index:
    """``path`` holds the blocks and, per task, the number of documents that hold each term."""

    spark: SparkSession
    path: str
    id_kind: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_index_schema(self.id_kind)).parquet(self.path)


def _index_schema(id_kind: str) -> str:
    return f"n_docs bigint, n_terms bigint, ids array<{id_kind}>, lengths array<bigint>, width bigint, slices binary, terms array<string>, counts array<bigint>"


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
    """Signatures and term counts of all documents, written in one pass over the texts.

    Documents without terms (NULL, empty, signs only) are not in it. NULL and repeated ids are kept, a row each.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    path, schema = path or new_path(spark, "signatures"), _index_schema(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([columns.get(field.name)], field.type) for field in arrow], schema=arrow)

    def block_of(block: tuple) -> pa.RecordBatch:
        ids, lengths, width, slices = block
        return batch_of(n_docs=len(ids), n_terms=sum(lengths), ids=ids, lengths=lengths, width=width, slices=slices)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen = Blocks(), Counter()
        for batch in batches:
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = Counter(words(one))
                if not of:
                    continue
                tf = np.fromiter(of.values(), dtype=np.int64, count=len(of))
                full = blocks.add(doc_id, int(tf.sum()), hashes_of(of), _levels(tf))
                if full:
                    yield block_of(full)
                seen.update(of.keys())
                if len(seen) > TERMS_HELD:
                    yield batch_of(terms=[term.decode() for term in seen], counts=[*seen.values()])
                    seen.clear()
        for block in blocks.rest():
            yield block_of(block)
        if seen:
            yield batch_of(terms=[term.decode() for term in seen], counts=[*seen.values()])

    docs.select(id_column, text).mapInArrow(index, schema).write.option("compression", "zstd").parquet(path)
    return Index(spark, path, kind)


@dataclass
class Item:
    number: int
    item_id: object
    # Each term with the number of times the item has it.
    terms: dict[bytes, int]


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[Item]]:
    """Items with terms, a bounded number and size at a time."""
    block, held = [], 0
    for number, (name, one) in enumerate(items.select(item_id, text).toLocalIterator()):
        terms = words(one)
        if not terms:
            continue
        size = sum(map(len, terms))
        if block and (len(block) == ITEMS_AT_ONCE or held + size > ITEM_BYTES_AT_ONCE):
            yield block
            block, held = [], 0
        block.append(Item(number, name, Counter(terms)))
        held += size
    if block:
        yield block


def _share(n, all_docs: int, all_terms: int):
    """What a document's length adds to each division: 25 at no terms, 100 at the mean."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * all_docs) // all_terms


@dataclass
class Query:
    """A block of items with the weights of their terms, as sent to the tasks."""

    items: list[Item]
    weights: dict[bytes, int]
    all_docs: int
    all_terms: int
    # By item: what a bound has to reach.
    least: np.ndarray | None = None

    def score(self, of: Counter, n: int, item: Item) -> int:
        m = _share(n, self.all_docs, self.all_terms)
        return sum(
            times * self.weights.get(term, 0) * (SCALE * of[term] // (1000 * of[term] + 8 * m)) for term, times in item.terms.items() if term in of
        )

    def bounds(self, lengths: np.ndarray, width: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the item, upper bound of each document's score)."""
        terms = [term for term, weight in self.weights.items() if weight > 0]
        if not terms:
            return
        hashes, row_of = hashes_of(terms), {term: row for row, term in enumerate(terms)}
        bits = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        m = np.array([_share(n, self.all_docs, self.all_terms) for n in lengths.tolist()], dtype=np.int64)
        most = [SCALE * tf // (1000 * tf + 8 * m) for tf in MORE_THAN[1:]] + [np.full(len(m), 1_000_000)]
        steps = [most[0], *[b - a for a, b in itertools.pairwise(most)]]
        present: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive, above = np.arange(len(terms)), None
        for level, step in enumerate(steps):
            found = np.bitwise_and.reduce(bits[places(hashes[alive], level, width)], axis=1)
            if above is not None:
                found &= above
            some = found.any(axis=1)
            alive, above = alive[some], found[some]
            if not len(alive):
                break
            at = np.full(len(terms), -1)
            at[alive] = np.arange(len(alive))
            present.append((at, np.unpackbits(above, axis=1, bitorder="little")[:, : len(m)], step.astype(np.float64)))
        for place, item in enumerate(self.items):
            rows = np.array([row_of[term] for term in item.terms if term in row_of], dtype=np.int64)
            if not len(rows):
                continue
            weights = np.array([times * self.weights[term] for term, times in item.terms.items() if term in row_of], dtype=np.float64)
            total = np.zeros(len(m))
            for at, matrix, step in present:
                there = at[rows]
                used = there >= 0
                if not used.any():
                    break
                total += step * (weights[used] @ matrix[there[used]].astype(np.float64))
            # Room for rounding, where sums are beyond what a double holds exactly.
            yield place, np.where(total > 0, np.floor(total * (1 + 1e-12)) + 1, 0).astype(np.int64)


def _weights(index: Index, block: list[Item], all_docs: int) -> dict[bytes, int]:
    """The weight of each term of a block that some document holds."""
    spark = index.spark
    wanted = spark.createDataFrame([(term.decode(),) for term in {term for item in block for term in item.terms}], "term string")
    counted = index.rows().filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), "t.counts")
    df = counted.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("counts").alias("df"))
    return {row.term.encode(): math.floor(1000 * math.log((2 * all_docs + 2) / (2 * row.df + 1))) for row in df.toLocalIterator()}


def _highest_bounds(index: Index, query: Query, top: int) -> DataFrame:
    """(place, doc_id, bound): the ``top`` highest bounds of each item in each task."""
    sent = index.spark.sparkContext.broadcast(query)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list]] = {}
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type.value_type
            for ids, lengths, width, slices in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                for place, bound in sent.value.bounds(np.array(lengths), width, slices):
                    chosen = np.flatnonzero(bound > 0)
                    if len(chosen) > top:
                        chosen = chosen[np.argpartition(-bound[chosen], top - 1)[:top]]
                    had_bounds, had_ids = best.get(place, (np.zeros(0, dtype=np.int64), []))
                    all_bounds, all_ids = np.concatenate([had_bounds, bound[chosen]]), had_ids + [ids[i] for i in chosen.tolist()]
                    order = np.argsort(-all_bounds, kind="stable")[:top]
                    best[place] = all_bounds[order], [all_ids[i] for i in order.tolist()]
        for place, (found, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), place, dtype=np.int32)), pa.array(ids, kind), pa.array(found)], names=["place", "doc_id", "bound"]
            )

    blocks = index.rows().filter("ids IS NOT NULL").select("ids", "lengths", "width", "slices")
    return blocks.mapInArrow(search, f"place int, doc_id {index.id_kind}, bound bigint")


def _reaching(index: Index, query: Query) -> DataFrame:
    """(doc_id, place) wherever a document's bound reaches what the item asks for."""
    sent = index.spark.sparkContext.broadcast(query)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = sent.value.least
        for batch in batches:
            kind = batch.column(0).type.value_type
            for ids, lengths, width, slices in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                docs, places_of = [], []
                for place, bound in sent.value.bounds(np.array(lengths), width, slices):
                    chosen = np.flatnonzero((bound > 0) & (bound >= least[place])).tolist()
                    docs += [ids[i] for i in chosen]
                    places_of += [place] * len(chosen)
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(places_of, pa.int32())], names=["doc_id", "place"])

    blocks = index.rows().filter("ids IS NOT NULL").select("ids", "lengths", "width", "slices")
    return blocks.mapInArrow(search, f"doc_id {index.id_kind}, place int")


def _scored(docs: DataFrame, wanted: DataFrame, query: Query, sent_whole: bool) -> DataFrame:
    """(place, doc_id, score) of every row of ``docs`` (doc_id, text) for the items that ``wanted`` (doc_id, place) names for its id."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(query)
    # Distinct first: an id that many rows share then has one row per item.
    by_id = wanted.select("doc_id", "place").distinct().groupBy("doc_id").agg(F.collect_list("place").alias("places")).withColumnRenamed("doc_id", "_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = sent.value
        for batch in batches:
            found = ([], [], [])
            for doc_id, one, places_of in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                split = words(one)
                of = Counter(split)
                for place in places_of:
                    value = query.score(of, len(split), query.items[place])
                    if value > 0:
                        for column, cell in zip(found, (place, doc_id, value), strict=True):
                            column.append(cell)
            kinds = (pa.int32(), batch.column(0).type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, of) for cells, of in zip(found, kinds, strict=True)], names=["place", "doc_id", "score"])

    pairs = docs.join(F.broadcast(by_id) if sent_whole else by_id, F.col("doc_id").eqNullSafe(F.col("_id")))
    return pairs.select("doc_id", "text", "places").mapInArrow(score, f"place int, doc_id {kind}, score bigint")


def search(
    index: Index, docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of the highest scores above 0 for each item, ranked from 1.

    ``index`` is that of ``docs``. Equal scores are ranked by ascending id, NULL first; rows with equal ids and scores share
    the remaining order arbitrarily and each have a rank. Items without terms, or whose terms no document holds, have no rows;
    repeated items and items with NULL ids are searched each for itself. Empty tables on either side give no rows; other
    columns are ignored.
    """
    spark = index.spark
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    id_kind, item_field = docs.schema[id_column].dataType, items.schema[item_id]
    result = StructType([
        StructField("item_id", item_field.dataType), StructField("rank", LongType()), StructField("doc_id", id_kind), StructField("score", LongType()),
    ])
    size = index.rows().agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    found = spark.createDataFrame([], result).withColumn("rank", F.col("rank").cast("int"))
    if not size.docs:
        return found
    for block in _item_blocks(items, item_id, item_text):
        query = Query(block, _weights(index, block, size.docs), size.docs, size.terms)
        first = _top(_highest_bounds(index, query, top), "bound", top)
        scores = _top(_scored(texts, first, query, True), "score", top).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        least = np.zeros(len(block), dtype=np.int64)
        for row in scores.toLocalIterator():
            least[row.place] = row.least if row.n == top else 0
        query.least = least
        wanted = written(_reaching(index, query), "reaching")
        ranked = _top(_scored(texts, wanted, query, wanted.count() <= SENT_ROWS), "score", top)
        names = spark.createDataFrame(
            [(place, item.item_id) for place, item in enumerate(block)], StructType([StructField("place", LongType()), StructField("item_id", item_field.dataType)])
        )
        found = found.unionByName(written(ranked.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return found


def _top(rows: DataFrame, by: str, top: int) -> DataFrame:
    return first_per_key(rows, ["place"], [F.desc(by), F.asc("doc_id")], top, rank="rank")
