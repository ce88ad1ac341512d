"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics are computed where a document is read, so scoring shuffles nothing. The trees are fitted on the driver from the
statistics (some thirty numbers a row) of a bounded, reproducible sample of labelled rows, flattened into arrays, and sent to
the tasks, which walk all trees for a batch of rows at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.columns import append_columns, without

# The most labelled documents that a fit uses: those with the smallest hash of their id.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
MIN_HESSIAN, L2 = 2.0, 1.0
THRESHOLD = 0.7

_SIGNS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "blanks": b" \t\r\n",
    "stops": b".?", "shouts": b"!", "commas": b",;:", "bars": b"|", "brackets": b"<>{}[]()", "quotes": b"'\"`", "marks": b"#$%&*@^~+=_/\\-",
}
_SIGN_TABLE = np.array([[byte in signs for signs in _SIGNS.values()] + [byte >= 0x80] for byte in range(256)], dtype=np.float64)
FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "longest_word", "short_words", "long_words", "distinct_words", "top_word",
    "repeats_last", "repeats_before_last", "starts_upper", "log_lines", "mean_line", "distinct_lines", "words_per_stop", *_SIGNS, "beyond_ascii",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; a NULL text is an empty one, of which all are 0."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    lengths, counts, lines = np.fromiter(map(len, words), dtype=np.float64), Counter(words), raw.split(b"\n")
    n, signs = len(words), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _SIGN_TABLE / len(raw)
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.__eq__, words, words[2:])) / n,
        sum(word[:1].isupper() for word in words) / n, float(np.log1p(len(lines))), float(np.log1p(len(raw) / len(lines))),
        len(set(lines)) / len(lines), float(np.log1p(n / (1 + raw.count(b".")))), *signs.tolist(),
    ]


@dataclass(frozen=True)
class Trees:
    """All trees in three arrays: node i of a tree has the children 2i + 1 and 2i + 2; a node without a gain sends all rows left."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    leaf: np.ndarray  # (trees, leaves)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        of, node = np.arange(trees), np.zeros((len(rows), trees), dtype=np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            values = np.take_along_axis(rows, self.feature[of, node], axis=1)
            node = 2 * node + 1 + (values > self.threshold[of, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[of, node - inner].sum(axis=1))))


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost ``trees`` trees on the log loss. Every level finds the best split of all its nodes from one gradient histogram.

    Without rows nothing is learned and every score is 1: there is no ground to reject anything.
    """
    inner, n = 2**depth - 1, len(labels)
    prior = (labels.sum() + 1) / (n + 1)
    base = 30.0 if prior >= 1 else float(np.log(prior / (1 - prior)))
    feature, threshold = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if n == 0:
        return Trees(base, feature, threshold, leaf)
    width = rows.shape[1]
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in rows.T]
    binned = np.stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, rows.T, strict=True)], axis=1)
    places, raw = binned + np.arange(width) * bins, np.full(n, base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-raw))
        gradient, hessian, node = chance - labels, np.maximum(chance * (1 - chance), 1e-9), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * bins) + places).ravel()
            g, h = (
                np.bincount(flat, np.repeat(values, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for values in (gradient, hessian)
            )
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (whole_g - g) ** 2 / (whole_h - h + L2) - whole_g**2 / (whole_h + L2)
            gain[(h < MIN_HESSIAN) | (whole_h - h < MIN_HESSIAN)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            found = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            column, at = best // bins, best % bins
            for i in np.flatnonzero(found).tolist():
                feature[tree, first + i], threshold[tree, first + i] = column[i], edges[column[i]][at[i]]
            mine = node - first
            right = found[mine] & (np.take_along_axis(binned, column[mine][:, None], axis=1)[:, 0] > at[mine])
            node = 2 * node + 1 + right
        node -= inner
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, hessian, inner + 1)
        leaf[tree] = -rate * g / (h + L2)
        raw += leaf[tree][node]
    return Trees(base, feature, threshold, leaf)


def held_out(id_column: str):
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED
) -> Trees:
    """Trees for ``label`` (0 or 1), from at most ``max_labelled`` labelled documents that are not held out.

    NULL labels and ids are not learned; contradicting labels of a document all are; documents that share an id count once.
    """
    sample = (
        labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
        .filter(~held_out("id")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    )
    known = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def start():
        return lambda texts: [pa.array([statistics(one) for one in texts.to_pylist()], pa.list_(pa.float64()))]

    rows = append_columns(known, [F.col("text")], "stats array<double>", start)
    fitted = rows.groupBy("id", "label").agg(F.min("stats").alias("stats")).orderBy("id", "label").collect()
    return fit_trees(np.array([row.stats for row in fitted]).reshape(-1, len(FEATURES)), np.array([row.label for row in fitted], dtype=np.float64))


def score_quality(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus held_out, score and predicted (1 from ``threshold`` on).

    The score depends on the text alone: NULL and empty texts get that of a text whose statistics are all 0, equal texts
    equal scores. An empty table stays empty; input columns named like a result are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        def score(texts: pa.Array) -> list[pa.Array]:
            rows = np.array([statistics(one) for one in texts.to_pylist()]).reshape(-1, len(FEATURES))
            return [pa.array(sent.value.scores(rows))]

        return score

    scored = append_columns(without(docs, ["held_out", "predicted"]), [F.col(text)], "score double", start)
    return scored.withColumns({"held_out": held_out(id_column), "predicted": (F.col("score") >= threshold).cast("int")})
