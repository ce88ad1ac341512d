"""Queries that rank: op11 documents for benchmark items, op13 phrases of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulwise.llm.collocations import mine_collocations
from haulwise.llm.lexical import build_index, search
from haulwise.llm.registry import query, table

SEARCH_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
shares AS (SELECT doc_id, 100 - 75 + ((75 * n * all_docs) // all_terms) AS m FROM lengths, totals),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, all_docs),
item_words AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), item_terms AS (SELECT item_id, term, count(*) AS times FROM item_words GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN shares USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_lexical_search", SEARCH_SQL)
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    docs = table(spark, sf_dir, "documents")
    return search(build_index(docs), docs, table(spark, sf_dir, "benchmark"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p, count(*) AS f
  FROM split, (SELECT unnest(range(1, 4)) AS k) AS sizes, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k
  GROUP BY lang, k, array_to_string(w[i : i + k - 1], ' ')
), sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM phrases WHERE k >= 2 AND f >= 10),
cut_at AS MATERIALIZED (
  SELECT lang, p, a, cut, array_to_string(w[1 : cut], ' ') AS lp, array_to_string(w[cut + 1 : k], ' ') AS rp
  FROM (SELECT lang, k, p, a, w, unnest(range(1, k)) AS cut FROM candidates)
), lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cut_at c JOIN phrases x ON x.lang = c.lang AND x.p = c.lp),
cuts AS (
  SELECT c.lang, c.p, c.a, c.cut, c.l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(c.l AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM lefts c JOIN phrases y ON y.lang = c.lang AND y.p = c.rp
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part
), left_over AS (
  SELECT t.lang, t.p AS phrase, a, l, r, score FROM lowest t LEFT JOIN inside i ON i.lang = t.lang AND i.part = t.p
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def collocation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return mine_collocations(table(spark, sf_dir, "documents"))
