"""Helpers that keep one very frequent key from landing in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulwise.session import cut_lineage

# A dimension of at most this many rows is broadcast; the masters have a few dozen bytes per row.
BROADCAST_MAX_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Measured, not estimated: counts at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a fact table to a dimension.

    A dimension measured as small is broadcast, so the fact side is never shuffled. A larger one goes through a
    shuffled join, where adaptive execution splits the partitions of hot keys.
    """
    return fact.join(F.broadcast(dim) if is_small(dim, max_rows) else dim, on, how)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key. The optimizer trims every input partition to ``n`` rows per key before the
    shuffle, so a hot key ships at most ``n`` rows per task."""
    column = rank or "_rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(column) <= n)
    return ranked if rank else ranked.drop(column)


def _chunk(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts))


def lag_by_key(
    df: DataFrame, key: str, ts: str, tiebreak: str, columns: dict[str, str], unit: str = "hour"
) -> DataFrame:
    """``lag`` within ``key`` ordered by (ts, tiebreak), computed per time chunk.

    The long history of one key is cut into chunks; inside a chunk it is an ordinary window, and the first row of each
    chunk takes its previous values from the last row of the key's preceding chunk, found on the one-row-per-chunk
    summary. ``columns`` maps each output name to the column it lags.
    """
    order = [F.col(ts), F.col(tiebreak)]
    within = Window.partitionBy(key, "_chunk").orderBy(*order)
    chunked = df.withColumn("_chunk", _chunk(ts, unit))
    last = chunked.groupBy(key, "_chunk").agg(
        F.max_by(F.struct(*[F.col(c).alias(out) for out, c in columns.items()]), F.struct(*order)).alias("_last")
    )
    carry = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk"))).drop("_last")
    inner = chunked.withColumns({out: F.lag(c).over(within) for out, c in columns.items()}).withColumn(
        "_first", F.row_number().over(within) == 1
    )
    joined = inner.join(carry, [key, "_chunk"], "left")
    return joined.withColumns(
        {out: F.when(F.col("_first"), F.col("_prev")[out]).otherwise(F.col(out)) for out in columns}
    ).drop("_chunk", "_first", "_prev")


def rank_by_key(
    df: DataFrame, key: str, ts: str, tiebreak: str, rank: str = "position", total: str = "total", unit: str = "hour"
) -> DataFrame:
    """``row_number`` and row count within ``key``, from per-chunk numbers plus the running size of earlier chunks."""
    chunked = df.withColumn("_chunk", _chunk(ts, unit))
    sizes = chunked.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(key)
    offsets = sizes.select(
        key, "_chunk",
        (F.sum("_n").over(per_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(per_key).alias(total),
    )
    within = Window.partitionBy(key, "_chunk").orderBy(ts, tiebreak)
    return (
        chunked.withColumn("_n", F.row_number().over(within))
        .join(offsets, [key, "_chunk"])
        .withColumn(rank, F.col("_before") + F.col("_n"))
        .drop("_chunk", "_n", "_before")
    )


def global_index(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows 1..n in ``order`` without a single-task window: a range-sorted write, then per-part offsets."""
    # Exact copies of a row are told apart by where they come from, so that the sort can spread them over tasks.
    marked = df.withColumn("_from", F.monotonically_increasing_id())
    parts = cut_lineage(marked.orderBy(*order, "_from").drop("_from").withColumn("_id", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_id", 33))
    # One row per sorted part: as many rows as the sort had partitions.
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    in_part = F.col("_id") - F.shiftleft("_part", 33)
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + in_part + 1)
        .drop("_id", "_part", "_before")
    )
