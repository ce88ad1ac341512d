"""Chat formatting from event logs, with DataFrame functions only.

A log holds one row per event: streamed deltas, edits and regenerations of the messages of a conversation. Events are folded
message by message (so the events of a long conversation are spread over tasks), rendered, and only the rendered messages of
one conversation meet in one row, which the format asks for.

Template: ``<|turn|>role<|text|>text<|end|>`` per message, ``<|learn|>`` instead of ``<|text|>`` where training learns from
the text. Inside roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;``, so no text can hold a control string,
and ``parse`` gets every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEARNED_ROLE = "assistant"
TURN, TEXT, LEARN, END = "<|turn|>", "<|text|>", "<|learn|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final text of every message.

    ``events`` has conv_id, message (any sortable value), seq, kind, role and text. In order of seq, a ``delta`` adds its
    text, an ``edit`` replaces the text so far with its own, a ``regenerate`` starts again from its own text (usually
    empty). Events of one message with equal seq are ordered by kind and text; a NULL kind counts as a delta, a NULL text
    as an empty one. The role is that of the first event that names one, else an empty string. NULL conv_id and message
    are values like any other.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role"
    )
    folded = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    resets = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: F.element_at("log", i)["kind"] != "delta")
    since = F.slice("log", F.coalesce(F.array_max(resets), F.lit(1)), F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda role: role.isNotNull())
    return folded.select(
        "conv_id", "message", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(since, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation, messages in order of ``message``.

    loss_spans are the code point ranges of ``formatted`` (end exclusive) under the loss mask: the escaped texts of
    ``learned_role``. Messages that tie are ordered by role and text. A table without rows gives none.
    """
    learned = F.col("role") == learned_role
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.when(learned, LEARN).otherwise(TEXT))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        messages.select("conv_id", "message", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), learned.alias("learned"))
        .withColumn("after", F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(order))
        .withColumn("end", F.col("after") - len(END))
        .withColumn("start", F.col("end") - F.char_length("body"))
    )
    segments = F.array_sort(F.collect_list(F.struct("start", "end", F.concat("head", "body", F.lit(END)).alias("segment"), "learned")))
    gathered = placed.groupBy("conv_id").agg(segments.alias("segments"))
    masked = F.filter("segments", lambda s: s["learned"])
    return gathered.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
        F.transform(masked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: an array of (role, learned, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda piece: piece != "")
    head = r"^<\|turn\|>([^<]*)<\|(text|learn)\|>"
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.regexp_extract(piece, head, 1)).alias("role"), (F.regexp_extract(piece, head, 2) == "learn").alias("learned"),
            unescape(F.regexp_replace(piece, head, "")).alias("text"),
        ),
    )


def log_of(turns: DataFrame, chunk: int = 400) -> DataFrame:
    """An event log as a chat service would have streamed it, from rows of (conv_id, turn, role, text).

    Each row is a message of its own: rows that repeat (conv_id, turn) are told apart by role, digest of the text and, for
    exact repeats, a counter; a NULL role is an empty one. Its text arrives in deltas of at most ``chunk`` characters; an empty
    or NULL text in one empty delta. By the digest of its text, a quarter of all messages first streams an answer that is
    discarded by a regeneration, and another quarter a wrong draft that an edit replaces.
    """
    text = F.coalesce("text", F.lit(""))
    copies = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    message = F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "copy").alias("message")
    # One pass over the text: cutting it at positions would walk from its start for each.
    cut = rows.select("conv_id", message, "role", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("found"))
    cut = cut.withColumn("chunks", F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit(""))))
    first = F.get("chunks", F.lit(0))

    def event(kind: str, of: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), of.alias("text"))

    def deltas(of: Column) -> Column:
        return F.transform(of, lambda chunk: event("delta", chunk))

    way = F.substring("message.digest", 1, 1)
    events = (
        F.when(way.isin(*"0123"), F.concat(F.array(event("delta", first), event("regenerate", F.lit(""))), deltas(F.col("chunks"))))
        .when(way.isin(*"4567"), F.concat(F.array(event("delta", F.reverse(first)), event("edit", first)), deltas(F.slice("chunks", 2, F.size("chunks")))))
        .otherwise(deltas(F.col("chunks")))
    )
    return cut.select("conv_id", "message", "role", F.posexplode(events).alias("seq", "event")).select(
        "conv_id", "message", "role", "seq", "event.kind", "event.text"
    )
