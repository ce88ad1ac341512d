"""Numbers of tokens per document, counted once per distinct pre-token.

A SentencePiece BPE model never joins a blank to the letter before it, nor anything to a line feed, if no piece of its
vocabulary does. Texts can then be cut before runs of blanks and around line feeds, and the number of pieces of a text is the
sum over its pre-tokens; no id of a document is ever made.

1. Every task counts pre-tokens and reports its most frequent ones; the ``head`` most frequent of all (a bounded number of
   bounded strings) are encoded once and sent to all tasks.
2. Every document's pre-token frequencies are weighed with the head where the document is read. What is not in the head stays
   beside the document as (pre-token, frequency) and is written with it.
3. Only those rare rows are shuffled, by pre-token and sorted, so that each is encoded once; the products are summed per document.

Which pre-tokens the head holds decides about time only, never about a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.columns import append_columns, without
from haulwise.llm.scratch import new_path

# The head: at most this many pre-tokens of at most this many bytes, so 14 MB of text.
HEAD = 300_000
HEAD_KEY_BYTES = 48
# Pre-tokens that a task counts at a time, and those of them that it reports.
COUNTED, REPORTED = 400_000, 60_000
BLANK = "▁"
# A line feed and the word after it, or blanks (stated by their stand-in) and the word after them.
UNITS = re.compile(f"\n[^{BLANK}\n]*|{BLANK}+[^{BLANK}\n]*")


class PieceCounter:
    """Splits texts into pre-tokens, and counts the pieces of a pre-token.

    A pre-token is stated by its text: without the first of its blanks, or with the line feed that it starts with. Models
    that are no BPE, change characters, or hold pieces across the cuts give the whole text as its only pre-token.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        rules = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            rules.ParseFromString(file.read())
        how, change, kind = rules.trainer_spec, rules.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        learned = [piece.piece for piece in rules.pieces if piece.type == kind.NORMAL]
        self.cuts = (
            how.model_type == how.BPE and how.byte_fallback and not how.treat_whitespace_as_suffix and not change.precompiled_charsmap
            and not change.normalization_rule_tsv and change.add_dummy_prefix and not change.remove_extra_whitespaces
            and change.escape_whitespaces and not any(piece.type == kind.USER_DEFINED for piece in rules.pieces)
            and BLANK in learned and not any(BLANK in piece.lstrip(BLANK) or "\n" in piece for piece in learned)
        )
        self.model = SentencePieceProcessor(model_file=path)

    def split(self, text: str) -> list[str]:
        if not self.cuts or not text:
            return [text] if text else []
        if BLANK not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        units = UNITS.findall(BLANK + text.replace(" ", BLANK))
        return [unit if unit[0] == "\n" else unit[1:] for unit in units]

    def count(self, keys: list[str]) -> np.ndarray:
        """Pieces of each pre-token. The library puts a blank before every text, which one that starts with a line feed does not have."""
        sizes = np.fromiter(map(len, self.model.encode([key.replace(BLANK, " ") for key in keys], num_threads=1)), dtype=np.int64, count=len(keys))
        if self.cuts:
            sizes += np.fromiter(((not key) - key.startswith("\n") for key in keys), dtype=np.int64, count=len(keys))
        return sizes


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """The counter of a model file, made once per process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _head(docs: DataFrame, text: str, model: str, head: int) -> dict[str, int]:
    """The most frequent short pre-tokens with their pieces."""

    def report(seen: Counter) -> pa.RecordBatch:
        keys, counts = zip(*seen.most_common(REPORTED), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["key", "n"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = piece_counter(model).split, Counter()
        for batch in batches:
            for one in batch.column(0).to_pylist():
                seen.update(split(one or ""))
            if len(seen) > COUNTED:
                yield report(seen)
                seen.clear()
        if seen:
            yield report(seen)

    counted = docs.select(text).mapInArrow(frequent, "key string, n long").filter(F.octet_length("key") <= HEAD_KEY_BYTES)
    best = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(head).select("key")
    keys = best.toArrow().column(0).to_pylist()
    return dict(zip(keys, piece_counter(model).count(keys).tolist(), strict=True))


def count_pieces(docs: DataFrame, model: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """The columns of ``docs`` other than ``text``, plus n_bytes (UTF-8) and n_tokens of the whole text, both long.

    Tokens are those of the model file without begin and end, with special strings in a text as ordinary text. NULL counts as
    an empty text, which has no tokens. Every row is counted for itself, repeated rows and NULL ids too, and a text without
    blanks, however long, is one pre-token. An empty table gives an empty table; input columns named like a result are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_head(docs, text, model, head))
    rare = pa.struct([("key", pa.string()), ("n", pa.int64())])

    def start():
        split, known = piece_counter(model).split, sent.value.get

        def weigh(texts: pa.Array) -> list[pa.Array]:
            totals, keys, counts, ends = [], [], [], [0]
            for one in texts.to_pylist():
                total = 0
                for key, n in Counter(split(one or "")).items():
                    pieces = known(key)
                    if pieces is None:
                        keys.append(key)
                        counts.append(n)
                    else:
                        total += n * pieces
                totals.append(total)
                ends.append(len(keys))
            pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], fields=list(rare))
            return [pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]

        return weigh

    fields = ["n_bytes", "n_tokens", "_llm_row", "_llm_rare", "_llm_sum", "_llm_text"]
    kept = without(docs, [*fields, text]).columns
    sized = docs.select(*[F.col(f"`{name}`") for name in kept], F.col(text).alias("_llm_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    weighed = append_columns(sized, [F.col("_llm_text")], "n_tokens long, _llm_rare array<struct<key: string, n: bigint>>", start, drop=["_llm_text"])
    path = new_path(spark, "pieces")
    weighed.withColumn("_llm_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last, last_pieces = piece_counter(model).count, None, 0
        for batch in batches:
            keys = batch.column(1).dictionary_encode()
            names = keys.dictionary.to_pylist()
            # A key that runs on from the batch before is not encoded again.
            known = names[:1] == [last]
            pieces = np.concatenate([[last_pieces] if known else [], count(names[known:])]).astype(np.int64)
            if names:
                last, last_pieces = names[-1], int(pieces[-1])
            products = pieces[keys.indices.to_numpy()] * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(products)], names=["_llm_row", "products"])

    by_key = rows.select("_llm_row", F.inline("_llm_rare")).repartition("key").sortWithinPartitions("key")
    sums = by_key.mapInArrow(encode, "_llm_row long, products long").groupBy("_llm_row").agg(F.sum("products").alias("_llm_sum"))
    return rows.drop("_llm_rare").join(sums, "_llm_row", "left").select(
        *[F.col(f"`{name}`") for name in kept], "n_bytes", (F.col("n_tokens") + F.coalesce("_llm_sum", F.lit(0))).alias("n_tokens")
    )
