"""Documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more, by an LSH forest and exact verification.

1. Documents with equal sets are one representative. Each representative has ``TREES`` MinHash signatures of ``DEPTH`` values.
2. Every tree is a prefix trie, held as the sorted list of its signatures: all trees are range-sorted together, and neighbours
   that share a prefix are candidates. The prefix is shortened until a pair at the threshold shares one in some tree with
   the target recall. Sorting by whole signatures puts the most similar documents side by side, so neighbours connect most
   of a popular prefix at the cost of one candidate per document.
3. Candidates whose whole signatures agree too little for the threshold (by four standard deviations) are dropped, which keeps
   documents that only share a passage apart. What remains falls into connected groups.
4. A prefix whose documents are still in several groups then has all their signatures compared across groups, block against
   block, so that unrelated documents between two similar ones cannot part them. Only a spanning forest of what agrees
   leaves a task, and joins groups.
5. Within a group all pairs are compared exactly, by products of 0/1 matrices. A group is cut into blocks of bounded size and
   each pair of blocks is a piece of work of its own, so no task holds a group. Only link counts and a spanning forest of
   the verified links leave a task, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from haulwise.llm.columns import without
from haulwise.llm.scratch import written
from haulwise.llm.words import words
from haulwise.operators.graph import connected_components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9999
# A block holds so many n-grams, where each document counts for some more.
BLOCK_WEIGHT, WEIGHT_PER_DOCUMENT = 250_000, 250
MATRIX_COLUMNS = 4096
MAX_CACHED_WORDS = 200_000
GRAMS_AT_ONCE = 2048
DEVIATIONS = 4.0
# Members of a prefix run in one block of signatures.
RUN_BLOCK = 1024


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that two documents at the threshold share in at least one tree with probability ``recall``."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


class Grams:
    """Sets of word n-grams as sorted arrays of 64-bit hashes."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def _word_hashes(self, text: str | None) -> np.ndarray:
        all_words, known = words(text), self.known
        for word in set(all_words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, all_words), dtype=np.uint64, count=len(all_words))
        if len(known) > MAX_CACHED_WORDS:
            known.clear()
        return hashes

    def __call__(self, text: str | None) -> np.ndarray:
        """A text of fewer than n words, but not none, has one n-gram: all its words."""
        hashes = self._word_hashes(text)
        size = min(self.n, len(hashes))
        if size == 0:
            return hashes
        count, grams = len(hashes) - size + 1, np.full(len(hashes) - size + 1, size, dtype=np.uint64)
        for at in range(size):
            grams = (grams ^ hashes[at : at + count]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        return np.unique(grams)


class Signatures:
    """MinHash values of a set of hashes: the smallest of a x + b in 32-bit arithmetic, for fixed pseudo-random a (odd) and b."""

    def __init__(self, trees: int, depth: int, prefix: int) -> None:
        random = np.random.default_rng(20240101)
        self.shape, self.prefix = (trees, depth), prefix
        self.a = random.integers(0, 1 << 31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 1 << 32, (trees * depth, 1), dtype=np.uint32)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(one sort key per tree, one byte per value). The upper half of a sort key is the hash of the prefix, the lower the next two levels."""
        folded, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(self.a.shape[0], 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(folded), GRAMS_AT_ONCE):
            np.minimum(least, (folded[at : at + GRAMS_AT_ONCE] * self.a + self.b).min(axis=1), out=least)
        mixed = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        levels, head = mixed.reshape(self.shape), np.zeros(self.shape[0], dtype=np.uint64)
        for level in range(self.prefix):
            head = ((head ^ levels[:, level]) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(11)
        key = (head & np.uint64(0xFFFFFFFF)) << np.uint64(32)
        for n, level in enumerate(range(self.prefix, min(self.prefix + 2, self.shape[1]))):
            key |= (levels[:, level] & np.uint64(0xFFFF)) << np.uint64(16 - 16 * n)
        return key.view(np.int64), (mixed & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), F.sha2(whole, 256).alias("text_key"), whole.alias("text"))


def _signed(docs: DataFrame, n: int, trees: int, depth: int, prefix: int) -> DataFrame:
    """Per row: doc_id, text_key, set_key (equal for equal sets), n_grams, sort keys and signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, signature = Grams(n), Signatures(trees, depth, prefix)
        for batch in batches:
            keys, sizes, paths, marks = [], [], [], []
            for text_key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                grams = grams_of(text)
                path, mark = signature(grams) if len(grams) else (np.zeros(0, dtype=np.int64), b"")
                # Without words there is no n-gram: only the same text is the same document.
                keys.append(xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else f"text {text_key}")
                sizes.append(len(grams))
                paths.append(path)
                marks.append(mark)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                    pa.array(paths, pa.list_(pa.int64())), pa.array(marks, pa.binary()),
                ],
                names=["doc_id", "text_key", "set_key", "n_grams", "paths", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, text_key string, set_key string, n_grams bigint, paths array<bigint>, signature binary")


def _neighbours(reps: DataFrame) -> DataFrame:
    """(a, b, tree, prefix): representatives that are neighbours in a sorted trie and share its prefix.

    The tries are range-sorted over all tasks; a prefix of very many documents is spread like any other stretch. The last
    row of a task and the first of the next are compared too: each task hands out its border rows.
    """
    rows = reps.filter("n_grams > 0").select("rep", F.posexplode("paths").alias("tree", "path"))
    ordered = rows.repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        names = ["a", "b", "tree", "prefix", "part", "last"]

        def border(row: np.ndarray, last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([int(row[2])]), pa.array([None], pa.int64()), pa.array([int(row[0])]), pa.array([int(row[1])]), pa.array([part], pa.int64()), pa.array([last])],
                names=names,
            )

        for batch in batches:
            table = np.stack([
                batch.column("tree").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("path").to_numpy(zero_copy_only=False) >> 32,
                batch.column("rep").to_numpy(zero_copy_only=False),
            ], axis=1)
            if not len(table):
                continue
            if before is None:
                yield border(table[0], False)
            else:
                table = np.concatenate([before, table])
            before = table[-1:]
            same = (table[1:, :2] == table[:-1, :2]).all(axis=1)
            a, b = table[:-1, 2][same], table[1:, 2][same]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(table[1:, 0][same]), pa.array(table[1:, 1][same]),
                    pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.bool_()),
                ],
                names=names,
            )
        if before is not None:
            yield border(before[0], True)

    found = written(ordered.mapInArrow(scan, "a bigint, b bigint, tree bigint, prefix bigint, part bigint, last boolean"), "neighbours")
    # Two rows per task.
    one, across = F.struct("tree", "prefix"), Window.orderBy("part", "last")
    borders = found.filter("b IS NULL").withColumns({"_key": F.lag(one).over(across), "_rep": F.lag("a").over(across)}).filter(F.col("_key") == one)
    borders = borders.filter("a != _rep").select(F.least("a", "_rep").alias("a"), F.greatest("a", "_rep").alias("b"), "tree", "prefix")
    return found.filter("b IS NOT NULL").select("a", "b", "tree", "prefix").unionByName(borders)


def _least_agreement(threshold: float, values: int) -> float:
    return values * threshold - DEVIATIONS * math.sqrt(values * threshold * (1 - threshold))


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float, values: int) -> DataFrame:
    """(src, dst, near) of candidate pairs; near: their signatures agree about as often as those of a pair at the threshold would."""
    least = _least_agreement(threshold, values)
    marks = reps.select("rep", "signature")
    both = (
        pairs.join(marks.withColumnsRenamed({"rep": "a", "signature": "mark_a"}), "a")
        .join(marks.withColumnsRenamed({"rep": "b", "signature": "mark_b"}), "b").select("a", "b", "mark_a", "mark_b")
    )

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint8).reshape(-1, values) for n in ("mark_a", "mark_b"))
            near = pa.array((one == other).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), near], names=["src", "dst", "near"])

    return both.mapInArrow(agree, "src bigint, dst bigint, near boolean")


def agreements(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values all signatures of two blocks (one per row, a byte per value) have in common."""
    if len(left) * len(right) <= 2048:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2)
    out, columns, others = np.zeros((len(left), len(right)), dtype=np.uint16), np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    for first in range(0, len(columns), 128):
        part = np.zeros(out.shape, dtype=np.uint8)
        for one, other in zip(columns[first : first + 128], others[first : first + 128], strict=True):
            part += (one[:, None] == other).view(np.uint8)
        out += part
    return out


def _joined_in_runs(neighbours: DataFrame, candidates: DataFrame, components: DataFrame, reps: DataFrame, threshold: float, values: int, run_block: int) -> DataFrame:
    """(src, dst): components (``components`` has rep and component) with members that share a prefix and whose signatures agree enough.

    Neighbours have been compared already, so only runs of three members or more with neighbours in different components are
    opened. A component of a block or more has blocks of its own, which are not compared with each other.
    """
    run = ["tree", "prefix"]

    def with_component(df: DataFrame, rep: str, name: str) -> DataFrame:
        known = components.select(F.col("rep").alias(rep), F.col("component").alias(name))
        return df.join(known, rep, "left").withColumn(name, F.coalesce(name, rep))

    apart = with_component(with_component(candidates.filter("NOT near").select(F.col("src").alias("a"), F.col("dst").alias("b")), "a", "_a"), "b", "_b")
    several = neighbours.groupBy(*run).count().filter("count > 1").select(*run)
    opened = neighbours.join(apart.filter("_a != _b").select("a", "b"), ["a", "b"], "left_semi").select(*run).distinct().join(several, run, "left_semi")
    chains = neighbours.join(opened, run, "left_semi")
    members = chains.select(*run, F.explode(F.array("a", "b")).alias("rep")).distinct()
    members = written(with_component(members, "rep", "component"), "runs")

    sized = members.groupBy(*run, "component").count().withColumn("part", F.when(F.col("count") >= run_block, F.col("component")).otherwise(F.lit(-1)))
    parts = sized.groupBy(*run, "part").agg(F.ceil(F.sum("count") / run_block).cast("int").alias("blocks"))
    before = Window.partitionBy(*run).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "first": F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"), "all_blocks": F.sum("blocks").over(Window.partitionBy(*run)).cast("int"),
    })
    places = sized.join(parts, [*run, "part"]).drop("count")
    placed = members.join(places, [*run, "component"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int"))
    own = (F.col("part") >= 0) & (F.col("other") >= F.col("first")) & (F.col("other") < F.col("first") + F.col("blocks"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))).filter(~own).select(
        *run, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "rep"
    )
    met = met.join(reps.select("rep", "signature"), "rep").drop("rep")
    key, least = [*run, "low", "high"], _least_agreement(threshold, values)

    def compare(members: list[tuple[int, int, bytes]], low: int, high: int) -> pa.RecordBatch:
        block, component = np.array([one[0] for one in members]), np.array([one[1] for one in members])
        marks = np.frombuffer(b"".join(one[2] for one in members), dtype=np.uint8).reshape(-1, values)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = np.nonzero((agreements(marks[left], marks[right]) >= least) & (component[left][:, None] != component[right]))
        joined, at = np.unique(np.concatenate([component[left][a], component[right][b]]), return_inverse=True)
        links = np.zeros((len(joined), len(joined)), dtype=bool)
        links[at[: len(a)], at[len(a) :]] = True
        roots = _roots(links) if len(joined) else joined
        kept = roots != np.arange(len(joined))
        return pa.RecordBatch.from_arrays([pa.array(joined[kept], pa.int64()), pa.array(joined[roots][kept], pa.int64())], names=["src", "dst"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for tree, prefix, low, high, *one in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tree, prefix, low, high) != current:
                    if len(held) > 1:
                        yield compare(held, current[2], current[3])
                    current, held = (tree, prefix, low, high), []
                held.append(one)
        if len(held) > 1:
            yield compare(held, current[2], current[3])

    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(join, "src bigint, dst bigint").distinct()


def _groups(neighbours: DataFrame, reps: DataFrame, threshold: float, values: int, run_block: int) -> DataFrame:
    """(rep, component): representatives in groups of those that share a prefix and whose signatures agree enough."""
    candidates = written(_likely(neighbours.select("a", "b").distinct(), reps, threshold, values), "candidates")
    pairs = candidates.filter("near").select("src", "dst")
    touched = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    components = written(connected_components(touched, pairs).withColumnRenamed("id", "rep"), "components")
    edges = written(_joined_in_runs(neighbours, candidates, components, reps, threshold, values, run_block), "joined")
    if edges.isEmpty():
        return components
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    joined = written(connected_components(ends, edges).select(F.col("id").alias("component"), F.col("component").alias("joined")), "joined")
    # A representative that neighbours left alone is a component of its own number.
    alone = joined.join(components.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("rep"), "component")
    return components.unionByName(alone).join(joined, "component", "left").select("rep", F.coalesce("joined", "component").alias("component"))


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, from the hashes that more than one set has."""
    values, inverse, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    split, shared = sum(map(len, left)), int((counts > 1).sum())
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets, columns in ((left, column[:split]), (right, column[split:])):
        row = np.repeat(np.arange(len(sets)), [len(one) for one in sets])
        order = np.argsort(columns, kind="stable")
        sides.append((row[order], columns[order]))
    for first in range(0, shared, MATRIX_COLUMNS):
        width, parts = min(MATRIX_COLUMNS, shared - first), []
        for (row, columns), n in zip(sides, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(columns, [first, first + width])
            matrix = np.zeros((n, width), dtype=np.float32)
            matrix[row[a:b], columns[a:b] - first] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def links_between(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which sets of two blocks are at least ``threshold`` similar, in whole numbers."""
    both = _intersections(left, right)
    sizes = np.array([len(one) for one in left])[:, None] + np.array([len(one) for one in right])
    return both * threshold.denominator >= (sizes - both) * threshold.numerator


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest number in the connected part of each vertex of a square link matrix."""
    root = np.arange(len(links))
    linked = links | links.T | np.eye(len(links), dtype=bool)
    while True:
        least = np.where(linked, root, len(links)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verified(groups: DataFrame, docs: DataFrame, n: int, threshold: float, block_weight: int) -> DataFrame:
    """(rep, links, root): links of each representative with those it met, and the smallest one it is connected with there.

    ``groups`` has rep, doc_id, text_key, n_grams, rows_of (documents of this set) and component.
    """
    weight = F.sum(F.col("n_grams") + WEIGHT_PER_DOCUMENT)
    blocks = groups.groupBy("component").agg(F.ceil(weight / block_weight).cast("int").alias("blocks"))
    placed = groups.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    same = placed["text_key"].eqNullSafe(docs["text_key"]) & placed["doc_id"].eqNullSafe(docs["doc_id"])
    texts = docs.join(placed, same).select("component", "blocks", "block", "rep", "rows_of", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, seen = Grams(n), set()
        for batch in batches:
            fresh = []
            for at, rep in enumerate(batch.column("rep").to_pylist()):
                if rep not in seen:  # repeated rows of one document
                    seen.add(rep)
                    fresh.append(at)
            part = batch.take(pa.array(fresh, pa.int64()))
            grams = [grams_of(text).view(np.int64) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(grams, pa.list_(pa.int64()))], names=["component", "blocks", "block", "rep", "rows_of", "grams"]
            )

    sets = texts.mapInArrow(cut, "component bigint, blocks int, block int, rep bigint, rows_of bigint, grams array<bigint>")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "rows_of", "grams"
    )
    key = ["component", "low", "high"]
    exact = Fraction(threshold).limit_denominator(10_000)

    def compare(members: dict[int, tuple[int, int, np.ndarray]], low: int, high: int) -> pa.RecordBatch:
        reps = np.array(sorted(members))
        of = [members[rep] for rep in reps.tolist()]
        rows, block = np.array([one[1] for one in of]), np.array([one[0] for one in of])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = np.zeros((len(reps), len(reps)), dtype=bool)
        if len(left) and len(right):
            found[np.ix_(left, right)] = links_between([of[i][2] for i in left.tolist()], [of[i][2] for i in right.tolist()], exact)
        found |= found.T
        np.fill_diagonal(found, False)
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(found @ rows), pa.array(reps[_roots(found)])], names=["rep", "links", "root"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, {}
        for batch in batches:
            lists = batch.column("grams")
            ends, values = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
            for at, (component, low, high, block, rep, rows) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:6]], strict=True)):
                if (component, low, high) != current:
                    if len(members) > 1:
                        yield compare(members, current[1], current[2])
                    current, members = (component, low, high), {}
                members[rep] = block, rows, values[ends[at] : ends[at + 1]].copy()
        if len(members) > 1:
            yield compare(members, current[1], current[2])

    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "rep bigint, links bigint, root bigint")


def find_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block_weight: int = BLOCK_WEIGHT, run_block: int = RUN_BLOCK,
) -> DataFrame:
    """(doc_id, text_key, class_no, class_id, n_links): one row per row of ``docs``.

    n_links is the number of other rows whose set of word n-grams is at least ``threshold`` similar, exact copies included;
    class_id the smallest id of all rows connected by such links, class_no a number of the class. text_key is the text's SHA-256. Words are runs of ASCII
    letters and digits and of characters beyond ASCII, A-Z as a-z. A text of fewer than ``n`` words has one n-gram. NULL is an empty text;
    texts without words are linked with equal texts only. Rows with NULL or repeated ids are rows like any other; class_id
    is NULL where no row of the class has an id. An empty table gives no rows; other columns are ignored.
    """
    prefix, rows = prefix_length(threshold, trees, depth, recall), _keyed(docs, id_column, text)
    signed = written(_signed(rows, n, trees, depth, prefix), "signed")
    sets = signed.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key", "n_grams", "paths", "signature")).alias("one"), F.count(F.lit(1)).alias("rows_of"), F.min("doc_id").alias("first_id")
    )
    reps = written(sets.select(F.monotonically_increasing_id().alias("rep"), "set_key", "one.*", "rows_of", "first_id"), "representatives")
    components = _groups(_neighbours(reps), reps, threshold, trees * depth, run_block)
    groups = written(reps.select("rep", "doc_id", "text_key", "n_grams", "rows_of").join(components, "rep"), "groups")
    verified = written(_verified(groups, rows, n, threshold, block_weight), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = verified.filter("root != rep").select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct()
    linked = connected_components(links.select(F.col("rep").alias("id")), edges).withColumnRenamed("id", "rep")
    classed = reps.select("rep", "set_key", "rows_of", "first_id").join(links, "rep", "left").join(linked, "rep", "left")
    classed = classed.withColumn("component", F.coalesce("component", "rep"))
    first = classed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_set = classed.join(first, "component").select("set_key", F.col("component").alias("class_no"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("rows_of") - 1).alias("n_links"))
    return signed.select("doc_id", "text_key", "set_key").join(by_set, "set_key").select("doc_id", "text_key", "class_no", "class_id", "n_links")


def keep_one_per_class(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` less all but one row of each class of near duplicates: the one with the smallest id, then text key; NULL ids last.

    Of rows that agree in both, one stays.
    """
    found = find_near_duplicates(docs, id_column, text, **options)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("one")
    one = found.groupBy("class_no").agg(least).select(F.col("one.doc_id").alias("_llm_id"), F.col("one.text_key").alias("_llm_key"))
    keyed = without(docs, ["_llm_id", "_llm_key", "_llm_text"]).withColumn("_llm_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    kept = keyed.join(one, (F.col("_llm_key") == F.col("_llm_text")) & F.col("_llm_id").eqNullSafe(keyed[id_column]), "left_semi")
    # Only rows that repeat both id and text are left to tell apart; without any, no second shuffle of whole rows is needed.
    if not _keyed(docs, id_column, text).groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_column, "_llm_text"])
    return kept.drop("_llm_text")
