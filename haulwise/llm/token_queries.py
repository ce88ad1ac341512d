"""Queries over tokens: op9 writes and reads token files, op10 packs sequences, op12 counts tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.llm import scratch
from haulwise.llm.packing import pack
from haulwise.llm.piece_counts import count_pieces
from haulwise.llm.registry import query, table
from haulwise.llm.token_files import read_token_files, with_checksums, write_token_files


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_token_files")
def token_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as token ids with end id 1, written to ORC files and read back from them."""
    path = scratch.new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return with_checksums(read_token_files(spark, path))


@query("op10_packing")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


# Documents of more tokens than this are over the limit.
TOKEN_LIMIT = 4096


@query("op12_token_counts")
def token_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole document by the SentencePiece model."""
    counted = count_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
