"""Graph analytics as iterated joins and aggregations; every round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulwise.operators.hotkeys import global_index
from haulwise.session import BucketLog, cut_and_measure, cut_in_buckets, cut_lineage, joined_by_fewer_keys

RESET = 0.15
ITERATIONS = 10
PAGERANK_CUT_EVERY = 5
SEEN_CUT_EVERY = 8
# A bucket holds some millions of arcs; the arcs of a vertex with more than this many are dealt over several buckets.
ARCS_PER_BUCKET = 4_000_000
ARCS_PER_PART = 1_000_000
LANDMARKS_PER_ROW = 64
# A search dealt by landmarks carries up to this many bitmaps side by side.
MAX_WORDS = 16
# Arcs are copied for a search dealt by landmarks unless there are over this many for each bitmap that a search dealt by vertices would move.
LINKS_PER_MOVE = 4
SPANS_PER_CORE = 4


def _write_links(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Write a (u, v) table and return it with its row count and an order-free hash sum."""
    written, figures = cut_and_measure(
        links, n=F.count(F.lit(1)), total=F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    )
    return written, (figures["n"], int(figures["total"]))


def _hang_on_smallest(neighbours: DataFrame) -> DataFrame:
    """(v, m) for every pair (u, v): m is the smallest id among u and its neighbours in the given table."""
    smallest = neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return neighbours.join(smallest, "u")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest vertex id that can be reached, edges taken as two-way.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): both hang neighbours on the smallest id
    seen, which shortens every tree until each vertex hangs on the smallest id of its component. The vertex sets of a
    step are reduced by a partial minimum, so the neighbours of a hub are never gathered in one place.
    """
    links, before = cut_lineage(
        edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    ), None
    while True:
        both_ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang_on_smallest(both_ways).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter(F.col("u") != F.col("v")).distinct())
        hung = _hang_on_smallest(large)
        small = (
            hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(hung.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        links, after = _write_links(small)
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(vertices: DataFrame, edges: DataFrame) -> bool:
    """True for one component, and for a graph without vertices."""
    return connected_components(vertices, edges).select("component").distinct().limit(2).count() <= 1


def _store_arcs(arcs: DataFrame, arcs_per_part: int = ARCS_PER_PART, distinct: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Arcs (src, dst) in buckets of (src, part), the vertices they leave (src, out_degree, parts), and the number of buckets.

    A vertex with many arcs has several parts, so none fills a bucket. What a round sends goes to ``parts`` copies of such a
    vertex; the arcs themselves are never moved again. ``distinct`` drops equal arcs inside their bucket, without a shuffle of its
    own. The arcs are read twice, so they should be a written table.
    """
    parts = F.ceil(F.col("out_degree") / arcs_per_part).cast("int").alias("parts")
    leaving, figures = cut_and_measure(
        arcs.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree")).select("src", "out_degree", parts),
        total=F.coalesce(F.sum("out_degree"), F.lit(0)),
    )
    buckets = max(arcs.sparkSession.sparkContext.defaultParallelism, -(-figures["total"] // ARCS_PER_BUCKET))
    hubs = leaving.filter("parts > 1").select("src", "parts")
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    stored = cut_in_buckets(arcs.select("src", "dst").join(hubs, "src", "left").select("src", part, "dst"), buckets, "src", "part", distinct=distinct)
    return stored, leaving, buckets


def _along(arcs: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows at the vertices ``id`` with their number of ``parts`` (NULL for one), carried along the stored arcs to ``dst``."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("copy")
    dealt = sent.select(*[c for c in sent.columns if c != "parts"], copies)
    return arcs.join(dealt, (F.col("src") == F.col("id")) & (F.col("part") == F.col("copy"))).drop("src", "part", "id", "copy")


def _rank_round(arcs: DataFrame, base: DataFrame, ranks: DataFrame, reset: float) -> DataFrame:
    """One round over (id, out_degree, parts, rank)."""
    sent = ranks.filter("out_degree IS NOT NULL").select("id", "parts", (F.col("rank") / F.col("out_degree")).alias("share"))
    received = _along(arcs, sent).groupBy("dst").agg(F.sum("share").alias("got"))
    rank = reset + (1 - reset) * F.coalesce("got", F.lit(0.0))
    return base.join(received, F.col("id") == F.col("dst"), "left").select("id", "out_degree", "parts", rank.alias("rank"))


def pagerank(
    vertices: DataFrame, edges: DataFrame, reset: float = RESET, iterations: int = ITERATIONS, arcs_per_part: int = ARCS_PER_PART
) -> DataFrame:
    """Static PageRank: start 1.0, a fixed number of rounds, dangling mass not redistributed, sum scaled to the number of
    vertices. Ends of edges that are no vertices receive nothing and pass nothing on.

    Arcs and vertices are stored in buckets once; a round moves the ranks and the partial sums of what is received.
    """
    return _pagerank(vertices, cut_lineage(edges.select("src", "dst")), reset, iterations, arcs_per_part)


def _pagerank(vertices: DataFrame, edges: DataFrame, reset: float = RESET, iterations: int = ITERATIONS, arcs_per_part: int = ARCS_PER_PART) -> DataFrame:
    """``pagerank`` over written edges."""
    arcs, leaving, buckets = _store_arcs(edges, arcs_per_part)
    known = vertices.select("id").distinct().join(leaving.withColumnRenamed("src", "id"), "id", "left")
    base = cut_in_buckets(known, buckets, "id")
    ranks = base.withColumn("rank", F.lit(1.0))
    for round_no in range(1, iterations + 1):
        ranks = _rank_round(arcs, base, ranks, reset)
        if round_no % PAGERANK_CUT_EVERY == 0 or round_no == iterations:
            ranks = cut_lineage(ranks)
    total = ranks.agg((F.sum("rank") / F.count(F.lit(1))).alias("mean")).scalar()
    return ranks.select("id", (F.col("rank") / total).alias("pagerank"))


def graph_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    # The edges are read three times.
    vertices, edges = cut_lineage(vertices), cut_lineage(edges.select("src", "dst"))
    components = connected_components(vertices, edges).withColumnRenamed("component", "community_id")
    return (
        vertices.join(components, "id").join(_pagerank(vertices, edges), "id").orderBy(F.desc(F.round("pagerank", 9)), "id")
    )


def landmarks(vertices: DataFrame) -> DataFrame:
    """High-criticality vertices, or the first vertex when there is none."""
    chosen = vertices.filter(F.col("criticality") == "high").select("id").distinct()
    return vertices.select("id").orderBy("id").limit(1) if chosen.isEmpty() else chosen


def hop_bitmaps(
    edges: DataFrame, targets: DataFrame, directed: bool = True, max_hops: int | None = None, arcs_per_part: int = ARCS_PER_PART
) -> tuple[DataFrame, DataFrame]:
    """(id, hops, block, bits): the targets that a vertex reaches in ``hops`` edges and no fewer, 64 to a row; and (block,
    names), the targets in the order of their bits.

    A breadth-first search from all targets at once over reversed edges. Bitmaps are joined by a bitwise OR and cleared of the bits the
    vertex had before; up to ``MAX_WORDS`` of them lie side by side in a row. NULL ids are no vertices.

    Where the targets fill a block for every core, a copy of the arcs fits a bucket and the arcs are few for each vertex, the search is dealt
    by blocks: the arcs are copied to each span of blocks once, and the rounds move nothing. Otherwise it is dealt by vertices (``_bitmaps_by_home``).
    """
    links, figures = cut_and_measure(
        edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL"),
        n=F.count(F.lit(1)), starts=F.approx_count_distinct("src"), ends=F.approx_count_distinct("dst"),
    )
    n_links, many, n_few = figures["n"], "src" if figures["starts"] >= figures["ends"] else "dst", min(figures["starts"], figures["ends"])
    n_steps = n_links if directed else 2 * n_links
    slot = F.col("position") - 1
    numbered = global_index(targets.filter("id IS NOT NULL").select("id").distinct(), [F.col("id")]).select(
        "id", F.floor(slot / LANDMARKS_PER_ROW).alias("block"), F.pmod(slot, F.lit(LANDMARKS_PER_ROW)).cast("int").alias("bit")
    )
    numbered, figures = cut_and_measure(numbered, n=F.count(F.lit(1)))
    names = numbered.groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bit", "id"))), lambda entry: entry["id"]).alias("names")
    )
    blocks = -(-figures["n"] // LANDMARKS_PER_ROW)
    first = numbered.select("id", "block", F.expr("shiftleft(1L, bit)").alias("bits"))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    if blocks >= cores and n_steps <= min(ARCS_PER_BUCKET, LINKS_PER_MOVE * n_few * cores):
        steps = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _bitmaps_by_span(steps if directed else steps.unionByName(links), first, blocks, max_hops)
    else:
        reached = _bitmaps_by_home(links, first, blocks, directed, n_links, many, max_hops, arcs_per_part)
    return reached, cut_lineage(names)


def _joined(df: DataFrame, keys: tuple[str, ...], bits: list[str], prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.bit_or(b).alias(f"{prefix}{b}") for b in bits])


def _fresh(
    arrived: DataFrame, reached: DataFrame, base: DataFrame | None, since: int, hops: int, keys: tuple[str, ...], bits: list[str]
) -> DataFrame:
    """What has arrived after ``hops`` edges and not before. ``base`` holds the bits of the first ``since`` hops, if any."""
    known = [_joined(reached.filter(F.col("hops") >= since), keys, bits, "late_")]
    if base is not None:
        known.append(base.select(*keys, *[F.col(b).alias(f"early_{b}") for b in bits]))
    for before in known:
        arrived = arrived.join(before.hint("merge"), list(keys), "left")
    nothing = F.lit(0).cast("long")

    def fresh(b: str) -> Column:
        had = F.coalesce(f"late_{b}", nothing)
        return F.col(b).bitwiseAND(F.bitwise_not(had if base is None else had.bitwiseOR(F.coalesce(f"early_{b}", nothing)))).alias(b)

    some = " OR ".join(f"{b} <> 0" for b in bits)
    return arrived.select(*keys, F.lit(hops).alias("hops"), *[fresh(b) for b in bits]).filter(some)


def _rounds(
    spark: SparkSession, buckets: int, keys: tuple[str, ...], start: DataFrame, bits: list[str], max_hops: int | None,
    one_round: Callable[[DataFrame, DataFrame | None, int, int], DataFrame],
) -> DataFrame:
    """The log of a search whose rows are dealt by the first of ``keys``; a round adds what is new."""
    with BucketLog(spark, buckets, *keys) as log, joined_by_fewer_keys(spark):
        found, hops, since, base = log.add(start, deal=True), 0, 0, None
        while found and (max_hops is None or hops < max_hops):
            hops += 1
            found = log.add(one_round(log.rows(), base, since, hops))
            if hops % SEEN_CUT_EVERY == 0 and found:
                with BucketLog(spark, buckets, *keys) as seen:
                    seen.add(_joined(log.rows(), keys, bits))
                    base, since = seen.rows(), hops + 1
        return log.rows()


def _side_by_side(first: DataFrame, words: int, *more: Column) -> DataFrame:
    """Rows of one block each as rows of a span of ``words`` blocks."""
    word = F.pmod("block", F.lit(words))
    return first.select(
        F.floor(F.col("block") / words).alias("span"), "id", *more, F.lit(0).alias("hops"),
        *[F.when(word == i, F.col("bits")).otherwise(F.lit(0).cast("long")).alias(f"bits_{i}") for i in range(words)],
    )


def _block_by_block(reached: DataFrame, words: int) -> DataFrame:
    """(id, hops, block, bits) from rows of spans."""
    wide = F.inline(F.array(*[F.struct((F.col("span") * words + i).alias("block"), F.col(f"bits_{i}").alias("bits")) for i in range(words)]))
    return reached.select("id", "hops", wide).filter("bits <> 0").select("id", "hops", "block", "bits")


def _span_round(arcs: DataFrame, reached: DataFrame, base: DataFrame | None, since: int, hops: int, bits: list[str]) -> DataFrame:
    """What vertices reach in ``hops`` edges and no fewer, in a search dealt by spans."""
    sent = reached.filter(F.col("hops") == hops - 1).select(F.col("span").alias("sent_span"), F.col("id").alias("sent_id"), *bits)
    along = arcs.join(sent.hint("merge"), (F.col("span") == F.col("sent_span")) & (F.col("src") == F.col("sent_id")))
    keys = ("span", "id")
    return _fresh(_joined(along.select("span", F.col("dst").alias("id"), *bits), keys, bits), reached, base, since, hops, keys, bits)


def _words(blocks: int, cores: int) -> int:
    """How many blocks lie side by side: as many as leave every core some spans."""
    return max(1, min(MAX_WORDS, blocks // (SPANS_PER_CORE * cores)))


def _bitmaps_by_span(steps: DataFrame, first: DataFrame, blocks: int, max_hops: int | None) -> DataFrame:
    """The rows of ``hop_bitmaps`` from a search dealt by spans, some blocks side by side. A span's arcs, frontier and known bits lie in the
    same bucket, so a round shuffles nothing and writes what is new; a task sorts one copy of the arcs for each span of its bucket."""
    spark = steps.sparkSession
    cores = spark.sparkContext.defaultParallelism
    words = _words(blocks, cores)
    bits, spans = [f"bits_{i}" for i in range(words)], -(-blocks // words)
    buckets = min(spans, SPANS_PER_CORE * cores)
    copies = steps.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("span"), "src", "dst")
    arcs = cut_in_buckets(copies, buckets, "span", distinct=True)

    def one_round(reached: DataFrame, base: DataFrame | None, since: int, hops: int) -> DataFrame:
        return _span_round(arcs, reached, base, since, hops, bits)

    return _block_by_block(_rounds(spark, buckets, ("span", "id"), _side_by_side(first, words), bits, max_hops, one_round), words)


def _number_per_bucket(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a number that a table bucketed by numbers keeps there, so that parts and buckets are the same."""
    number = F.col("id").cast("int")
    found = spark.range(100 * buckets).groupBy(F.pmod(F.hash(number), F.lit(buckets)).alias("bucket")).agg(F.min(number).alias("number"))
    return [r["number"] for r in found.orderBy("bucket").collect()]


def _home_round(
    arcs: DataFrame, goals: DataFrame, part: Callable[[str], Column], buckets: int, reached: DataFrame, base: DataFrame | None, since: int,
    hops: int, bits: list[str],
) -> DataFrame:
    """What vertices reach in ``hops`` edges and no fewer, in a search dealt by vertices."""
    keys = ("part", "id", "span")
    sent = reached.filter(F.col("hops") == hops - 1).select(*keys, *bits)
    # From homes to other ends: joined in the part of the home first, then moved.
    out = arcs.filter("outward").join(sent.withColumnRenamed("id", "home").hint("merge"), ["part", "home"])
    out = _joined(out, ("part", "away", "span"), bits).select(part("away").alias("part"), F.col("away").alias("id"), "span", *bits)
    # From other ends to homes: moved once to each part that has such homes.
    dealt = goals.join(sent.hint("merge"), ["part", "id"]).select(F.col("goal").alias("part"), F.col("id").alias("away"), "span", *bits)
    inward = arcs.filter("inward").join(dealt.repartition(buckets, "part").hint("merge"), ["part", "away"])
    arrived = out.repartition(buckets, "part").unionByName(inward.select("part", F.col("home").alias("id"), "span", *bits))
    return _fresh(_joined(arrived, keys, bits), reached, base, since, hops, keys, bits)


def _bitmaps_by_home(
    links: DataFrame, first: DataFrame, blocks: int, directed: bool, n_links: int, many: str, max_hops: int | None, arcs_per_part: int
) -> DataFrame:
    """The rows of ``hop_bitmaps`` from a search dealt by vertices. A link lies in the part of its home, the end on the side with more
    vertices, or the other end where that home has over ``arcs_per_part`` links. A round moves bitmaps of the other ends only, at most one to or from
    each part; what homes have stays where it is."""
    spark = links.sparkSession
    words = min(MAX_WORDS, max(1, blocks))
    bits = [f"bits_{i}" for i in range(words)]
    buckets = max(spark.sparkContext.defaultParallelism, -(-n_links // ARCS_PER_BUCKET))
    numbers = F.array(*[F.lit(n) for n in _number_per_bucket(spark, buckets)])

    def part(vertex: str) -> Column:
        return F.element_at(numbers, F.pmod(F.xxhash64(vertex), F.lit(buckets)).cast("int") + 1)

    few = "dst" if many == "src" else "src"
    hubs, figures = cut_and_measure(links.groupBy(many).count().filter(F.col("count") > arcs_per_part).select(many), n=F.count(F.lit(1)))
    if figures["n"]:
        links = links.join(hubs.withColumn("hub", F.lit(True)), many, "left")
    at_many = F.col("hub").isNull() if figures["n"] else F.lit(True)
    home, away = F.when(at_many, F.col(many)).otherwise(F.col(few)), F.when(at_many, F.col(few)).otherwise(F.col(many))
    # Bits go from the end of an edge to its start.
    at_start = at_many if many == "src" else ~at_many
    inward, outward = (at_start, ~at_start) if directed else (F.lit(True), F.lit(True))
    placed = links.select(home.alias("home"), away.alias("away"), inward.alias("inward"), outward.alias("outward"))
    arcs = cut_in_buckets(placed.select(part("home").alias("part"), "*"), buckets, "part", distinct=True)
    goals = arcs.filter("inward").groupBy("part", "away").agg(F.lit(1)).select(part("away").alias("to"), F.col("away").alias("id"), F.col("part").alias("goal"))
    goals = cut_in_buckets(goals.withColumnRenamed("to", "part"), buckets, "part")

    def one_round(reached: DataFrame, base: DataFrame | None, since: int, hops: int) -> DataFrame:
        return _home_round(arcs, goals, part, buckets, reached, base, since, hops, bits)

    start = _side_by_side(first, words, part("id").alias("part"))
    return _block_by_block(_rounds(spark, buckets, ("part", "id", "span"), start, bits, max_hops, one_round), words)


def hop_distances(
    edges: DataFrame, targets: DataFrame, directed: bool = True, max_hops: int | None = None, arcs_per_part: int = ARCS_PER_PART
) -> DataFrame:
    """(source_id, target_id, hop_distance): fewest edges from every vertex to every target it can reach, 0 to itself.

    The bitmaps of ``hop_bitmaps``, spelt out: one row per vertex and target it reaches.
    """
    reached, names = hop_bitmaps(edges, targets, directed, max_hops, arcs_per_part)
    # Bits are tried before names are touched.
    tried = reached.join(names, "block").select("*", F.explode(F.sequence(F.lit(0), F.lit(LANDMARKS_PER_ROW - 1))).alias("bit")).filter("getbit(bits, bit) = 1")
    return tried.select(F.col("id").alias("source_id"), F.col("names")[F.col("bit")].alias("target_id"), F.col("hops").alias("hop_distance"))


def hop_maps(distances: DataFrame) -> DataFrame:
    """The map form: one row per vertex with its target-to-hops map (as many entries as there are targets)."""
    return distances.groupBy("source_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("target_id", "hop_distance")))).alias("distances")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, all other columns shared."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def with_missing_reverse(edges: DataFrame) -> DataFrame:
    """Add the reverse of an edge only where no edge of its own runs that way."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.unionByName(reverse.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(
        F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"),
        (F.sum("degree") / 2).cast("bigint").alias("edges"),
    )
