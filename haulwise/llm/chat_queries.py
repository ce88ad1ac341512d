"""Query of chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.llm.chat import fold_events, log_of, parse, render
from haulwise.llm.registry import query, table

# A conversation whose texts look like another template's control strings.
CONTROL_ROWS = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(role, '&', '&amp;'), '<', '&lt;') AS r, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(r) + CASE WHEN role = 'assistant' THEN 9 ELSE 8 END + length(t) + 7) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op7_chat", CHAT_SQL)
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rebuilt from its event log, formatted, and read back from the format."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_ROWS))
    formatted = render(fold_events(log_of(turns))).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
