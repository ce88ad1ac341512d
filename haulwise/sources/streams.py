"""Streaming sources: Kafka topics, or folders of JSON lines with the same shape of output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class StreamSource:
    """Where a stream of JSON texts comes from.

    With ``brokers`` it is a Kafka topic with a start position and a cap on offsets per trigger; without, ``path`` is a
    folder of text files with a cap on files per trigger.
    """

    path: str | None = None
    brokers: str | None = None
    topic: str | None = None
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int = 8000
    max_files_per_trigger: int = 1000


def read_event_stream(spark: SparkSession, source: StreamSource) -> DataFrame:
    """One JSON text per row in ``value``."""
    if source.brokers:
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", source.brokers)
            .option("subscribe", source.topic)
            .option("startingOffsets", source.starting_offsets)
            .option("maxOffsetsPerTrigger", source.max_offsets_per_trigger)
            .load()
            .select(F.col("value").cast("string").alias("value"))
        )
    return spark.readStream.option("maxFilesPerTrigger", source.max_files_per_trigger).text(source.path)
