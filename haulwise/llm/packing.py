"""Vector bin packing of token sequences by the dot-product heuristic, under three limits at a time.

Every task packs the documents of its own input partition: a sequence never needs a document of another task, so nothing is
shuffled and a lost executor costs only its own partitions. Per task at most one sequence is left open at the end; with
cutting it is split into sequences whose sizes are powers of two, so it needs no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.tokens import encoder, merged


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``loss_tokens`` counts the tokens that training learns from."""

    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096


# Pieces that a task keeps in hand to choose from.
POOL = 512
ROWS_OUT = 2000
END_ID = 2


class Packer:
    """Packs the pieces of one task; ``place(document, start, length, sequence, offset)`` receives every piece once.

    A document is (handle, tokens, first loss-bearing token). ``cut`` allows a piece to be cut to fill a sequence; without
    it only documents beyond a limit are cut.
    """

    def __init__(self, limits: Limits, cut: bool, place: Callable, pool: int = POOL) -> None:
        self.limits, self.cut, self.place, self.pool = limits, cut, place, pool
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64)
        self.pieces: list[tuple[object, int, int, int]] = []
        self.sequence = 0

    def _loss(self, start: int, end: int, first: int) -> int:
        return max(0, end - max(start, first))

    def _fitting(self, start: int, end: int, first: int, tokens: int, loss: int) -> int:
        """The largest length from ``start`` within both token limits."""
        return min(tokens, end - start, max(0, first - start) + loss)

    def add(self, document: object, length: int, first: int) -> None:
        start = 0
        while start < length:
            size = self._fitting(start, length, first, self.limits.tokens, self.limits.loss_tokens)
            if size == self.limits.tokens:
                self.place(document, start, size, self.sequence, 0)
                self.sequence += 1
            else:
                self.pieces.append((document, start, start + size, first))
            start += size
        # A sequence started with this many pieces in hand ends full: pieces are cut where none fits.
        while len(self.pieces) > self.pool:
            self._one_sequence()

    def finish(self) -> None:
        while self.pieces:
            self._one_sequence()

    def _one_sequence(self) -> None:
        sizes = np.array([(end - start, 1, self._loss(start, end, first)) for _, start, end, first in self.pieces], dtype=np.int64)
        weights = sizes / self.full
        rest, chosen = self.full.copy(), []
        free = np.ones(len(sizes), dtype=bool)
        while True:
            fits = free & (sizes <= rest).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, weights @ (rest / self.full), -1.0)))
            free[best] = False
            chosen.append(self.pieces[best])
            rest -= sizes[best]
        left = [piece for piece, still in zip(self.pieces, free.tolist(), strict=True) if still]
        if self.cut and left and rest[0] > 0 and rest[1] > 0:
            lengths = [self._fitting(start, end, first, int(rest[0]), int(rest[2])) for _, start, end, first in left]
            best = int(np.argmax(lengths))
            if lengths[best] > 0:
                document, start, end, first = left[best]
                middle = start + lengths[best]
                chosen.append((document, start, middle, first))
                left[best] = (document, middle, end, first)
        self.pieces = left
        self._close(chosen, split=self.cut and not left)

    def _close(self, chosen: list[tuple[object, int, int, int]], split: bool) -> None:
        """Place one sequence; the last of a task is split into powers of two where cutting is allowed."""
        total = sum(end - start for _, start, end, _ in chosen)
        room = self.limits.tokens if not split or total == self.limits.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for document, start, end, _ in chosen:
            while start < end:
                if offset == room:
                    total -= room
                    self.sequence, offset, room = self.sequence + 1, 0, 1 << (total.bit_length() - 1)
                size = min(end - start, room - offset)
                self.place(document, start, size, self.sequence, offset)
                start, offset = start + size, offset + size
        self.sequence += 1


def pack(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True, id_column: str = "doc_id", text_column: str = "text",
    loss_from: str | None = None, end_id: int = END_ID, with_tokens: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, tokens]): one row per piece.

    A document is the ids of its whole text and ``end_id``; a NULL text is an empty one, so each document has at least one
    token. ``loss_from`` names an integer column: the number of leading tokens (such as a prompt's) that training does not
    learn from; NULL or no such column is 0. Every id lies in exactly one piece, the pieces of a sequence lie gapless from
    offset 0, and no sequence breaks a limit. Repeated rows and rows with equal or NULL ids are packed each for itself; an
    empty table gives no rows; other columns are ignored. Sequences are to be padded to ``limits.tokens`` unless their
    size is a power of two. ``sequence_id`` is the task's number and the sequence's number in the task.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    first = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), first.alias("first"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [part.split()[0] for part in schema.split(", ")] + ["tokens"] * with_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, out = encoder(tokenizer), []
        base, end = TaskContext.get().partitionId() << 33, np.array([end_id], dtype="<u4").tobytes()

        def place(document: tuple, start: int, length: int, sequence: int, offset: int) -> None:
            name, ids = document
            piece = ids[4 * start : 4 * (start + length)]
            row = (name, start, length, zlib.crc32(piece), len(ids) // 4, base + sequence, offset)
            out.append((*row, np.frombuffer(piece, dtype="<i4")) if with_tokens else row)

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_tokens]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(values, of) for values, of in zip(columns, kinds, strict=True)], names=names)

        packer, id_type = Packer(limits, cut, place), pa.int64()
        for batch in merged(batches, 1):
            id_type = batch.column(0).type
            coded = ids_of(batch.column(1).to_pylist())
            for name, ids, learn in zip(batch.column(0).to_pylist(), coded, batch.column(2).to_pylist(), strict=True):
                packer.add((name, ids + end), len(ids) // 4 + 1, max(0, learn))
                if len(out) >= ROWS_OUT:
                    yield rows_out()
        packer.finish()
        if out:
            yield rows_out()

    return rows.mapInArrow(run, schema + (", tokens array<int>" if with_tokens else ""))
