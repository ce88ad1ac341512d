"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the 13-word windows of the benchmark items. A text is read at one position per step: the pair of words that
ends there is looked up in a shift table. A pair in no window lets the search skip twelve words; a pair nearer to a window's
start skips as far as it safely can; a pair that ends windows leads to its bucket, where whole windows are compared.
Items shorter than a window are patterns of their own length with their own tables.

Documents are neither shuffled nor grouped: each is searched where it is read. The tables of at most ``block_bytes`` of
benchmark text are sent to the tasks at a time; a larger benchmark takes several passes over the rows, each of which adds to
the hits found so far.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.columns import append_columns, without
from haulwise.llm.words import words

WINDOW = 13
BLOCK_BYTES = 8 << 20
# A document is contaminated if at least one in this many of its words is hit.
HIT_WORDS_IN = 20

Windows = dict[tuple[bytes, ...], set]


class WordSearch:
    """Wu-Manber tables for patterns of one length; blocks are pairs of words, or single words for patterns of one word."""

    def __init__(self, patterns: Windows) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.skip = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], Windows] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block, distance = pattern[end - self.block : end], self.length - end
                if distance < self.shift.get(block, self.skip):
                    self.shift[block] = distance
            self.buckets.setdefault(pattern[-self.block :], {})[pattern] = items

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of every window in the text."""
        shift, skip, length, block, end, size = self.shift.get, self.skip, self.length, self.block, self.length, len(text)
        while end <= size:
            last = tuple(text[end - block : end])
            step = shift(last, skip)
            if step:
                end += step
                continue
            items = self.buckets[last].get(tuple(text[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def windows(items: Iterable[tuple[object, str | None]], length: int = WINDOW) -> dict[int, Windows]:
    """By length: each window's items. Items without words have none."""
    found: dict[int, Windows] = {}
    for item, text in items:
        all_words = words(text)
        size = min(length, len(all_words))
        for start in range(len(all_words) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(all_words[start : start + size]), set()).add(item)
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most ``block_bytes`` of text (or one item), streamed through the driver a partition at a time. The last one may be empty."""
    rows = benchmark.select(F.col(item_id).cast("string"), text)
    block, held = [], 0
    for item, item_text in rows.toLocalIterator():
        size = len((item_text or "").encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, item_text))
        held += size
    yield block


def _with_hits(docs: DataFrame, block: list[tuple[str, str]], text: str, window: int) -> DataFrame:
    """``docs`` with n_words, and the hits of one block added to ``_llm_hits`` (flat starts and ends) and ``_llm_items``."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def start():
        searches = [WordSearch(patterns) for patterns in windows(sent.value, window).values()]

        def search(texts: pa.Array, hits: pa.Array, items: pa.Array) -> list[pa.Array]:
            sizes, all_hits, all_items = [], [], []
            for document, had, knew in zip(texts.to_pylist(), hits.to_pylist(), items.to_pylist(), strict=True):
                split, spans, names = words(document), list(itertools.batched(had, 2)), set(knew)
                for one in searches:
                    for at, of in one.occurrences(split):
                        spans.append((at, at + one.length))
                        names |= of
                sizes.append(len(split))
                all_hits.append([*itertools.chain.from_iterable(merged(spans))])
                all_items.append(sorted(name for name in names if name is not None))
            return [pa.array(sizes, pa.int64()), pa.array(all_hits, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string()))]

        return search

    inputs = [F.col(text), F.col("_llm_hits"), F.col("_llm_items")]
    return append_columns(docs, inputs, "n_words long, _llm_hits array<long>, _llm_items array<string>", start)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items (ids as sorted strings), hit_spans (first word, word after the last) and contaminated.

    A document's word is hit if it lies in any occurrence of a window: ``window`` consecutive words of an item, or all words of
    a shorter item. NULL and empty texts have no words and are never contaminated, and NULL or empty items have no windows.
    Items without an id are searched like others, but not reported among the items; repeated items count once by id. Repeated rows of ``docs`` are
    each searched; an empty table on either side is fine. Input columns named like a result are replaced.
    """
    fields = ["n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]
    found = without(docs, [*fields, "_llm_hits", "_llm_items"]).withColumns({
        "_llm_hits": F.expr("CAST(array() AS ARRAY<BIGINT>)"), "_llm_items": F.expr("CAST(array() AS ARRAY<STRING>)"),
    })
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        found = _with_hits(found, block, text, window)

    spans = F.expr("transform(sequence(0, size(_llm_hits) DIV 2 - 1), i -> named_struct('first', _llm_hits[2 * i], 'after', _llm_hits[2 * i + 1]))")
    n_hit = F.expr("aggregate(hit_spans, CAST(0 AS BIGINT), (n, s) -> n + s.after - s.first)")
    return (
        found.withColumn("hit_spans", F.when(F.size("_llm_hits") > 0, spans).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<first: BIGINT, after: BIGINT>>)")))
        .withColumns({"n_hit": n_hit, "n_items": F.size("_llm_items").cast("long"), "items": F.col("_llm_items")})
        .withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_WORDS_IN * F.col("n_hit") >= F.col("n_words")))
        .drop("_llm_hits", "_llm_items")
    )
