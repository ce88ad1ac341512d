"""New columns computed batch by batch in Python while all others pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns that would clash with ``names`` (Spark ignores case)."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in taken])


def append_columns(df: DataFrame, inputs: list[Column], new: str, start: Callable[[], Callable[..., list[pa.Array]]], drop=()) -> DataFrame:
    """``df`` plus the columns of the schema text ``new``; a column of ``df`` with such a name is replaced.

    Columns in ``drop`` do not pass through. ``start()`` runs once per task and returns a function from the Arrow arrays of ``inputs`` to the new arrays.
    """
    added = StructType.fromDDL(new)
    kept = without(df, [*added.fieldNames(), *drop])
    packed = df.select(*[F.col(f"`{name}`") for name in kept.columns], *[column.alias(f"_llm_in_{n}") for n, column in enumerate(inputs)])
    width, schema = len(kept.columns), StructType([*kept.schema.fields, *added.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            arrays = compute(*batch.columns[width:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=names)

    return packed.mapInArrow(run, schema)
