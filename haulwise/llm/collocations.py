"""Phrase collocations: exact counts by multikey quicksort of suffix pointers, scored by their least cohesive cut.

1. Words are counted per language. Each gets a 64-bit code whose uniqueness is checked on the word table itself, so that
   everything after it sorts integers. A word that is too rare ends a suffix: no phrase that holds it can be frequent.
2. Every task sorts the suffixes of its texts to the depth of the longest phrase (multikey three-way quicksort), so that equal ones
   leave it once with their number, packed by the bucket of their leading two words. Where both are among the most frequent words
   of all, the third decides too, so no pair of words can fill a bucket.
3. Every bucket is sorted the same way. The size of an equal partition is the count of its phrase, and a partition below the least
   count is left unsorted. Pairs whose suffixes were spread over buckets are added up.
4. Parts are looked up by joins, and scores are exact integers of 38 digits.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.scratch import written
from haulwise.operators.hotkeys import first_per_key

LEAST, LONGEST, TOP = 10, 3, 2000
# A candidate goes if a longer one that holds it has this share of its count, in percent.
ABSORBED_PERCENT = 50
NO_LANGUAGE = "und"
# Words that a task counts at a time, and codes it remembers.
WORDS_HELD = 200_000
# Suffixes that a task sorts at a time, and those that a bucket is to hold.
SORTED_AT_ONCE, BUCKET_SUFFIXES = 1_000_000, 2_000_000
# A word that makes up more than one in so many of all occurrences is heavy; there are fewer heavy words than that.
HEAVY_ONE_IN = 2000
# Frequent words whose codes are sent to the tasks (8 bytes each); beyond it rare words are left in the suffixes.
SENT_CODES = 2_000_000
# Partitions of fewer suffixes are sorted at once instead of around a pivot.
SMALL = 8192
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(0x2E if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = b"."


def pieces(text: str | None) -> list[bytes]:
    """The words of a text in lower case, with ``END`` wherever a piece ends."""
    return (text or "").encode().translate(_LOWER).replace(END, b" . ").split()


def code(lang: str, word: bytes, seed: int) -> int:
    """A code from 2 on; 0 ends a suffix, and 1 is free."""
    return max(2, xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh3_64_intdigest(lang, seed=seed)))


def multikey_runs(keys: list[np.ndarray], weights: np.ndarray, least: int, whole: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers to one member each, summed weights) of all equal partitions with at least ``least`` of weight.

    ``keys[d]`` is the word of every suffix at depth d, 0 behind its end; suffixes that end earlier are no phrase of that
    depth. Partitions around a pivot are split in three; the middle one goes on at the next depth. A partition below
    ``least`` is abandoned, but for those at a depth up to ``whole``.
    """
    deepest = len(keys)

    def small(pointers: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.lexsort([keys[d][pointers] for d in range(deepest - 1, depth - 1, -1)])
        pointers = pointers[order]
        change = np.zeros(len(pointers), dtype=bool)
        change[0] = True
        for d in range(depth, deepest):
            of = keys[d][pointers]
            change[1:] |= of[1:] != of[:-1]
            starts = np.flatnonzero(change)
            sums = np.add.reduceat(weights[pointers], starts)
            keep = (of[starts] != 0) & ((sums >= least) | (d < whole))
            if keep.any():
                yield d, pointers[starts[keep]], sums[keep]

    open_parts = [(np.flatnonzero(keys[0]), 0)]
    while open_parts:
        pointers, depth = open_parts.pop()
        if not len(pointers) or depth >= whole and weights[pointers].sum() < least:
            continue
        if len(pointers) <= SMALL:
            yield from small(pointers, depth)
            continue
        of = keys[depth][pointers]
        sample = np.sort(of[:: max(1, len(of) // 63)])
        pivot = sample[len(sample) // 2]
        same = pointers[of == pivot]
        open_parts += [(pointers[of < pivot], depth), (pointers[of > pivot], depth)]
        total = int(weights[same].sum())
        if pivot and (total >= least or depth < whole):
            yield depth, same[:1], np.array([total])
            if depth + 1 < deepest:
                longer = same[keys[depth + 1][same] != 0]
                open_parts.append((longer, depth + 1))


def _word_table(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, code, f): all words of each language."""

    def batch_of(seen: Counter) -> pa.RecordBatch:
        (langs, found), counts = zip(*seen, strict=True), [*seen.values()]
        codes = np.array([code(lang, word, seed) for lang, word in seen], dtype=np.uint64).view(np.int64)
        columns = [pa.array(langs, pa.string()), pa.array([w.decode() for w in found], pa.string()), pa.array(codes), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "code", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        for batch in batches:
            for lang, one in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                by_lang.setdefault(lang, Counter()).update(pieces(one))
            if sum(map(len, by_lang.values())) > WORDS_HELD:
                yield batch_of(_flat(by_lang))
                by_lang.clear()
        flat = _flat(by_lang)
        if flat:
            yield batch_of(flat)

    return docs.mapInArrow(count, "lang string, word string, code bigint, f bigint").groupBy("lang", "word", "code").agg(F.sum("f").alias("f"))


def _flat(by_lang: dict[str, Counter]) -> Counter:
    return Counter({(lang, word): n for lang, seen in by_lang.items() for word, n in seen.items() if word != END})


def _distinct_codes(docs: DataFrame) -> tuple[DataFrame, int]:
    """The word table and the seed under which no two words share a code."""
    for seed in itertools.count():
        table = written(_word_table(docs, seed), "words")
        if table.groupBy("code").count().filter("count > 1").isEmpty():
            return table, seed
    raise AssertionError


def _both_heavy(keys: list[np.ndarray], heavy: np.ndarray) -> np.ndarray:
    return np.isin(keys[0], heavy) & np.isin(keys[1], heavy)


def _bucket(keys: list[np.ndarray], heavy: np.ndarray, buckets: int) -> np.ndarray:
    first, second = keys[0], keys[1]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    if len(heavy) and len(keys) > 2:
        mixed = np.where(_both_heavy(keys, heavy), mixed ^ (keys[2] * np.uint64(0x165667B19E3779F9)), mixed)
    return (((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(buckets)


def _pack(keys: list[np.ndarray], weights: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*[key.tobytes() for key in keys], weights.astype("<i8").tobytes()]))


def _unpack(packed: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype="<u8").reshape(depth + 1, -1)
    return list(columns[:depth]), columns[depth].astype(np.int64)


def _merged(keys: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes made one."""
    # The whole suffix is the deepest partition once a mark stands where it ends.
    marked = [keys[0], *[np.where(key == 0, np.uint64(1), key) for key in keys[1:]]]
    found = [(at, sums) for depth, at, sums in multikey_runs(marked, weights, 0) if depth == len(keys) - 1]
    if not found:
        return [key[:0] for key in keys], weights[:0]
    at = np.concatenate([pointers for pointers, _ in found])
    return [key[at] for key in keys], np.concatenate([sums for _, sums in found])


def _dealt_suffixes(docs: DataFrame, seed: int, longest: int, frequent: np.ndarray | None, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, suffixes): the different suffixes of two words and more of each task with their numbers."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, heavy))

    class Codes(dict):
        """Codes of the words of one language; 0 for the end of a piece and for words that are too rare."""

        def __init__(self, lang: str, known: np.ndarray | None) -> None:
            super().__init__({END: 0})
            self.lang, self.known = lang, known

        def __missing__(self, word: bytes) -> int:
            found = code(self.lang, word, seed)
            if self.known is not None:
                place = int(np.searchsorted(self.known, np.uint64(found)))
                found = found if place < len(self.known) and int(self.known[place]) == found else 0
            if len(self) > WORDS_HELD:
                self.clear()
                self[END] = 0
            self[word] = found
            return found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_lang, held, size = sent.value[0], {}, [], 0
        gap = np.zeros(longest, dtype=np.uint64)

        def packed() -> Iterator[pa.RecordBatch]:
            row = np.concatenate([*held, gap])
            keys = [row[: len(row) - longest], *[row[d : len(row) - longest + d] for d in range(1, longest)]]
            chosen = (keys[0] != 0) & (keys[1] != 0)
            keys = [key[chosen] for key in keys]
            for d in range(2, longest):
                keys[d] = np.where(keys[d - 1] == 0, np.uint64(0), keys[d])
            keys, counts = _merged(keys, np.ones(len(keys[0]), dtype=np.int64))
            to = _bucket(keys, sent.value[1], buckets)
            order = np.argsort(to, kind="stable")
            starts = np.flatnonzero(np.diff(to[order], prepend=np.uint64(buckets)))
            for start, end in itertools.pairwise([*starts.tolist(), len(order)]):
                part = order[start:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(to[part[0]])], pa.int64()), pa.array([_pack([key[part] for key in keys], counts[part])], pa.binary())], names=["bucket", "suffixes"]
                )

        for batch in batches:
            for lang, one in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                split = pieces(one)
                if lang not in of_lang:
                    of_lang[lang] = Codes(lang, known)
                held += [np.fromiter(map(of_lang[lang].__getitem__, split), dtype=np.uint64, count=len(split)), gap]
                size += len(split)
                if size > SORTED_AT_ONCE:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    return docs.mapInArrow(cut, "bucket bigint, suffixes binary")


def _counted(dealt: DataFrame, longest: int, least: int, heavy: np.ndarray) -> DataFrame:
    """(size, c0, c1, ..., a): phrases of two words and more. Pairs of heavy words come in parts from several buckets, whatever their number there."""
    sent = dealt.sparkSession.sparkContext.broadcast(heavy)
    names = [f"c{d}" for d in range(longest)]

    def runs(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(one, longest) for one in held]
        keys, counts = [np.concatenate([part[0][d] for part in parts]) for d in range(longest)], np.concatenate([part[1] for part in parts])
        spread = _both_heavy(keys, sent.value)
        for chosen, whole in ((~spread, 0), (spread, 2)):
            of = [key[chosen] for key in keys]
            for depth, at, sums in multikey_runs(of, counts[chosen], least, whole):
                if depth:
                    codes = [of[d][at] if d <= depth else np.zeros(len(at), dtype=np.uint64) for d in range(longest)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), depth + 1, dtype=np.int32)), *[pa.array(c.view(np.int64)) for c in codes], pa.array(sums)], names=["size", *names, "a"]
                    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, suffixes in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if bucket != current:
                    if held:
                        yield from runs(held)
                    current, held = bucket, []
                held.append(suffixes)
        if held:
            yield from runs(held)

    by_bucket = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(count, f"size int, {', '.join(f'{name} bigint' for name in names)}, a bigint")


def mine_collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed_percent: int = ABSORBED_PERCENT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    Words are in lower case (A-Z only), lie between blanks and tabs, and phrases stay within pieces, which end at .,;:!? and line ends.
    ``a`` is a phrase's number of occurrences (``least`` at least), ``l`` and ``r`` those of its parts at the cut of the lowest score
    floor(1,000,000 a² / (l r)), the first such cut if several; ``n`` is the number of words of the language. Phrases inside a
    longer one of ``absorbed_percent`` of their count are dropped. Order: score and a descending, then phrase in bytes.
    A NULL language is "und"; NULL and empty texts have no words; repeated rows count each. An empty table, or one
    without frequent phrases, gives no rows. Other columns are ignored.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    words, seed = _distinct_codes(texts)
    totals = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.count_if(F.col("f") >= least).alias("frequent")).first()
    frequent = words.filter(F.col("f") >= least)

    def codes(rows: DataFrame) -> np.ndarray:
        return np.sort(rows.select("code").toArrow().column(0).to_numpy().view(np.uint64))

    heavy = codes(frequent.filter(F.col("f") > totals.n // HEAVY_ONE_IN))
    known = codes(frequent) if totals.frequent <= SENT_CODES else None
    dealt = _dealt_suffixes(texts, seed, longest, known, heavy, max(1, totals.n // BUCKET_SUFFIXES))
    names = [f"c{d}" for d in range(longest)]
    phrases = written(_counted(dealt, longest, least, heavy).groupBy("size", *names).agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "phrases")

    by_code = frequent.select("code", "word", "f", F.col("lang").alias("_lang"))
    scored = reduce(DataFrame.unionByName, [_scored(phrases, by_code, size, longest) for size in range(2, longest + 1)])
    inside = [
        phrases.filter(F.col("size") == size).select(
            F.lit(short).alias("size"), *[F.col(names[start + d]).alias(names[d]) if d < short else F.lit(0).cast("long").alias(names[d]) for d in range(longest)],
            F.col("a").alias("longer"),
        )
        for size in range(3, longest + 1) for short in range(2, size) for start in range(size - short + 1)
    ]
    if inside:
        holding = reduce(DataFrame.unionByName, inside).groupBy("size", *names).agg(F.max("longer").alias("longer"))
        scored = scored.join(holding, ["size", *names], "left").filter(
            F.col("longer").isNull() | (100 * F.col("longer") < absorbed_percent * F.col("a"))
        )
    counts = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = first_per_key(scored.select("lang", "phrase", "a", "l", "r", "score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, rank="rank")
    return ranked.join(counts, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, words: DataFrame, size: int, longest: int) -> DataFrame:
    """Phrases of one size with language, text and the counts and score of their lowest cut."""
    names = [f"c{d}" for d in range(longest)]
    rows = phrases.filter(F.col("size") == size)
    for d in range(size):
        of = words.select(F.col("code").alias(names[d]), F.col("word").alias(f"w{d}"), F.col("f").alias(f"f{d}_{d + 1}"), *([F.col("_lang").alias("lang")] if d == 0 else []))
        rows = rows.join(of, names[d])
    for start in range(size - 1):
        for end in range(start + 2, size + 1):
            if (start == 0) != (end == size):
                part = phrases.filter(F.col("size") == end - start).select(
                    *[F.col(names[d]).alias(names[start + d]) for d in range(end - start)], F.col("a").alias(f"f{start}_{end}")
                )
                rows = rows.join(part, names[start:end])
    cuts = []
    for k in range(1, size):
        left, right = f"f0_{k}", f"f{k}_{size}"
        squared, parts = "1000000 * CAST(a AS DECIMAL(38, 0)) * a", f"CAST({left} AS DECIMAL(38, 0)) * {right}"
        score = F.expr(f"({squared}) DIV ({parts})")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    lowest = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *[f"w{d}" for d in range(size)])
    return rows.select("size", *names, "lang", phrase.alias("phrase"), "a", lowest.alias("_cut")).select(
        "size", *names, "lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"
    )
