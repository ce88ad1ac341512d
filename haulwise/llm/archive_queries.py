"""Queries over stored bytes: op1 writes and reads web archives, op3 transport streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulwise.llm import scratch, warc
from haulwise.llm.registry import query, table
from haulwise.llm.transport import read_streams, to_streams

WARC_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM rows
"""


@query("op1_warc", WARC_SQL)
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    path = scratch.new_path(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(index, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_transport_streams")
def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a transport stream and read back."""
    stored = scratch.written(to_streams(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "streams", codec="zstd")
    return read_streams(stored)
