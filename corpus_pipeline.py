"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.llm.decontamination import find_contamination
from haulwise.llm.line_dedup import drop_repeated_lines
from haulwise.llm.near_duplicates import keep_one_per_class
from haulwise.llm.packing import pack
from haulwise.llm.quality import fit_quality, score_quality
from haulwise.llm.registry import small_batches, table
from haulwise.llm.scratch import written
from haulwise.llm.token_queries import tokenizer_file


OWN = ("doc_id", "text")


def _set_aside(docs: DataFrame) -> DataFrame:
    """The columns that the operators read, and all others in one, out of reach of columns that an operator adds under their names."""
    return docs.select(*OWN, F.struct(*[F.col(f"`{name}`") for name in docs.columns if name not in OWN]).alias("_llm_rest"))


def _restored(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(name) if name in OWN else F.col(f"_llm_rest.`{name}`").alias(name) for name in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _restored(score_quality(_set_aside(docs), trees).filter("predicted = 1"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that ten or more of them have; n_chars follows the text."""
    small_batches(spark)
    found, changed = drop_repeated_lines(_set_aside(docs)), F.col("n_dropped") > 0
    size = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _restored(
        found.withColumns({
            "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
            "_llm_rest": F.col("_llm_rest").withField("n_chars", F.when(changed, size).otherwise(F.col("_llm_rest.n_chars"))),
        }),
        docs.columns,
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    small_batches(spark)
    return _restored(keep_one_per_class(_set_aside(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a little of the benchmark."""
    small_batches(spark)
    found = find_contamination(_set_aside(docs), table(spark, sf_dir, "benchmark"))
    return _restored(found.filter(~F.col("contaminated")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    small_batches(spark)
    return pack(docs, tokenizer_file())


STAGES = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]

# The classifier and the tokenizer are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
