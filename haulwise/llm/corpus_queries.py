"""Queries of the operators that clean a corpus of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.llm.decontamination import find_contamination
from haulwise.llm.line_dedup import drop_repeated_lines
from haulwise.llm.near_duplicates import find_near_duplicates
from haulwise.llm.pii import base_only, counts, find_personal_data, listed
from haulwise.llm.quality import fit_quality, score_quality
from haulwise.llm.registry import query, table

DECONTAMINATION_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size
), found AS (SELECT d.doc_id, d.i, d.size, m.item FROM doc_windows d JOIN item_windows m ON d.win = m.win AND d.size = m.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def contamination_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against all windows of the benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)
), frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id
"""


@query("op6_line_dedup", LINE_DEDUP_SQL)
def line_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document less the lines that ten or more documents have."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_quality")
def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query("op2_pii")
def personal_data_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    spans = F.col("spans")
    return found.select("doc_id", *[n.alias(name) for name, n in counts(spans).items()], F.sha2(listed(base_only(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"))


NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS gram
  FROM doc_words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 10 * s.n >= 8 * (x.n + y.n - s.n)
  UNION ALL
  SELECT x.doc_id, y.doc_id FROM doc_words x JOIN doc_words y ON x.text = y.text AND x.doc_id < y.doc_id WHERE len(x.w) = 0
), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""


@query("op8_near_duplicates", NEAR_DUPLICATE_SQL)
def near_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every whole document and its number of links."""
    return find_near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
