"""Token ids in ORC files: run-length coded integer lists in stripes, with row indexes and Bloom filters on document ids.

``write_token_files`` sorts documents over all files by id, so stripe and row-group statistics are narrow and a lookup of a
few ids reads only the row groups that can hold them. ``read_token_files`` gives one row per document; stripes are read in
parallel as Spark splits the files.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from haulwise.llm.tokens import encoder, merged

END_ID = 1
STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX_ENTRY = 1000
BLOOM_FALSE_POSITIVES = 0.01


def _schema(id_kind: str) -> str:
    return f"doc_id {id_kind}, part int, before bigint, n_tokens bigint, tokens array<int>"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID,
    stripe_bytes: int = STRIPE_BYTES, rows_per_index_entry: int = ROWS_PER_INDEX_ENTRY, codec: str = "zstd",
) -> None:
    """Encode every whole text, append ``end_id`` and write ORC files in ascending order of id.

    A NULL text is an empty one. NULL ids come first; rows with equal ids are ordered by their place in the input, so
    repeated rows are all kept and one id that holds many rows is still spread over files. An empty table gives files
    without rows. Other columns are not written. Each row also holds the number of its file part and the number of ids
    before it in that part, from which ``read_token_files`` gets global positions without sorting again.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # The ranges are sampled from ids and places alone, so that the texts are read once.
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in merged(batches, 1):
            coded = [ids + end for ids in ids_of(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *[len(ids) // 4 for ids in coded]])
            values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(coded), part, dtype=np.int32)), pa.array(ends[:-1] + before),
                    pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values),
                ],
                names=["doc_id", "part", "before", "n_tokens", "tokens"],
            )
            before += int(ends[-1])

    ordered.select("doc_id", "text").mapInArrow(
        encode, _schema(kind)
    ).write.options(**{
        "compression": codec, "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true",
        "orc.row.index.stride": str(rows_per_index_entry), "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(BLOOM_FALSE_POSITIVES),
    }).orc(path)


def read_token_files(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, tokens): start is the number of ids of all documents before this one.

    The only rows gathered are one per file part, whose number the writer chose; the token column is read once.
    """
    files = spark.read.schema(_schema(id_kind)).orc(path)
    parts = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("_ids"))
    running = F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    offsets = parts.select("part", (running - F.col("_ids")).alias("_offset"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("_offset") + F.col("before")).alias("start"), "n_tokens", "tokens"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list, id_kind: str = "bigint") -> DataFrame:
    """The rows of a few documents; the filter reaches the scan, which skips stripes and row groups by statistics and Bloom filter."""
    return read_token_files(spark, path, id_kind).filter(F.col("doc_id").isin(doc_ids))


def with_checksums(rows: DataFrame) -> DataFrame:
    """Replace ``tokens`` by their count and the unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    import zlib

    kept = [name for name in rows.columns if name not in ("tokens", "n_tokens")]
    schema = ", ".join([*[f"{name} {rows.schema[name].dataType.simpleString()}" for name in kept], "n_tokens long", "ids_crc32 long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in itertools.pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=[*kept, "n_tokens", "ids_crc32"],
            )

    return rows.select(*kept, "tokens").mapInArrow(run, schema)
