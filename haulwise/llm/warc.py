"""WARC archives written and read by all tasks at once, through an index.

Every task writes archives of its own, one gzip member per record, and hands back an index row (file, offset, length, URL,
digest) per record. The index is a Parquet table, so it holds only rows of tasks that Spark has committed; files of lost or
repeated attempts are never referred to. Readers start from the index: the selected records are sorted by place, neighbours
are fetched with one byte-range read, and each record is cut out of the range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 512 << 20
# Records of one file within such a stretch are read by one task, in ranges of at most RANGE_BYTES (or one record).
STRETCH_BYTES, RANGE_BYTES, GAP_BYTES = 32 << 20, 4 << 20, 64 << 10
ROWS_OUT = 500
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space of URLs
INDEX = (
    "file string, offset bigint, length bigint, url string, payload_digest string, payload_bytes bigint, record_type string, page_id string, refers_to string"
)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: str | None, payload_digest: str) -> str:
    return f"<{uuid.uuid5(_NAMES, f'{page_id}/{payload_digest}').urn}>"


def _head(lines: list[tuple[str, str | None]], first: str) -> bytes:
    return "\r\n".join([first, *[f"{name}: {value}" for name, value in lines if value is not None], "", ""]).encode()


def _plain(quoted: str | None) -> str | None:
    return None if quoted is None else urllib.parse.unquote(quoted)


def _quoted(page_id: str | None) -> str | None:
    """An id as one header value, whatever characters it has."""
    return None if page_id is None else urllib.parse.quote(page_id, safe="")


def to_record(page_id: str | None, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only; its Content-Length tells the size of the payload it leaves out."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    target = urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else f"urn:page:{_quoted(page_id)}"
    head = _head(
        [
            ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, payload_digest)), ("WARC-Date", date),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", _record_id(refers_to, payload_digest) if revisit else None), ("Page-ID", _quoted(page_id)),
            ("Refers-To-Page-ID", _quoted(refers_to) if revisit else None), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
        "WARC/1.1",
    )
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(member: bytes) -> dict:
    """What a record holds; a payload that does not match its digest is an error, never a row."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if not head.startswith(b"WARC/1.1\r\n") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, told, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(_fields(http)["Content-Length"])
    if kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _plain(fields.get("Page-ID")), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": told, "payload_bytes": length,
        "refers_to": _plain(fields.get("Refers-To-Page-ID")), "payload": payload if kind == "response" else None,
    }


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_responses(pages: DataFrame, page_id: str, payload: Column, min_revisit_bytes: int) -> DataFrame:
    """``pages`` plus _payload, _revisit and _refers_to.

    The smallest id per payload comes from a partially aggregated table of digests. Only payloads that more than one row has
    are joined back, and rows of a hot payload are split by adaptive execution.
    """
    keyed = pages.withColumn("_payload", payload).withColumn("_key", F.concat_ws(":", F.sha1("_payload"), F.octet_length("_payload")))
    first = (
        keyed.filter(F.octet_length("_payload") >= min_revisit_bytes).groupBy("_key")
        .agg(F.min(page_id).alias("_first"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
    )
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(page_id))
    return keyed.join(first, "_key", "left").withColumns({"_revisit": other, "_refers_to": F.when(other, F.col("_first"))})


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row to archives below ``path`` and return the index, read back from ``path``/index.

    The payload is the page in UTF-8, empty for NULL. Of rows with equal payloads of at least ``min_revisit_bytes`` the one
    with the smallest id is a response and the others revisit it; rows that repeat that id are all responses, as are
    smaller payloads. A NULL id is never the smallest unless all are NULL, when all are responses. A NULL or empty URL
    becomes urn:page:<id>. Other columns are not written. An empty table gives an empty index.
    """
    rows = with_responses(
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "page_id",
        F.coalesce(F.col("html"), F.lit("")).cast("binary"), min_revisit_bytes,
    ).select(F.col("page_id").cast("string"), "url", "_payload", F.col("_refers_to").cast("string"), "_revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(path)
        part, name, out, at = TaskContext.get().partitionId(), "", None, 0
        schema = pa.schema([(field.split()[0], pa.int64() if field.endswith("bigint") else pa.string()) for field in INDEX.split(", ")])
        try:
            for batch in batches:
                index = []
                for page, link, payload, refers_to, revisit in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    told = digest(payload)
                    record = to_record(page, link, payload, told, refers_to, revisit, date)
                    out.write(record)
                    index.append((name, at, len(record), link, told, len(payload), "revisit" if revisit else "response", page, refers_to))
                    at += len(record)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in index], schema=schema)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return read_index(pages.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(selected: DataFrame, path: str, with_payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload]) of the index rows in ``selected``.

    A selection with gaps costs one range read per run of near neighbours. Sizes and digests of responses are those of the
    payload read; a revisit carries those of the payload it refers to and has a NULL payload.
    """
    # As many tasks as the archives have stretches: the index rows that are dealt out say nothing about the bytes behind them.
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    stretches = max(1, -(-total // STRETCH_BYTES))
    places = selected.select("file", "offset", "length").repartition(stretches, "file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
    columns = {
        "page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(),
        "refers_to": pa.string(), "payload": pa.binary(),
    }
    if not with_payload:
        del columns["payload"]
    schema = pa.schema(list(columns.items()))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, run = None, []
        for batch in batches:
            for file, offset, length in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                near = file == name and offset - sum(run[-1]) <= GAP_BYTES and offset + length - run[0][0] <= RANGE_BYTES
                if not near:
                    if run:
                        yield name, run
                    name, run = file, []
                run.append((offset, length))
        if run:
            yield name, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(path)
        opened, source, rows = None, None, []
        for name, run in ranges(batches):
            if name != opened:
                opened, source = name, system.open_input_file(f"{folder}/{name}")
            first = run[0][0]
            content = memoryview(source.read_at(sum(run[-1]) - first, first))
            for offset, length in run:
                rows.append(parse_record(content[offset - first : offset - first + length]))
            if len(rows) >= ROWS_OUT:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    found = places.mapInArrow(read, ", ".join(f"{name} {kinds[kind]}" for name, kind in columns.items()))
    return found.withColumns({name: F.col(name).cast(id_type) for name in ("page_id", "refers_to")})
