"""Rows that every operator has to cope with, and plain Python counterparts of the shared text rules."""

from __future__ import annotations

import re

LONG = " ".join(f"word{n % 977} über{n % 13}." for n in range(9000))
TEXTS = [
    "Plain text of a few words, nothing else in it.", None, "", " \n\t\n ", "one", "...!!!", LONG,
    "The same line\nas in others\nThe same line", "The same line\n\n x \nThe same line ", "mail me@example.org or call +1 (555) 123-4567 now",
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, spans int, n_lines int, kept_text int, media int, "
    "n_bytes string, rep string, component int, tokens int, part int, start int, line int, tag int, stats int, class_id int, text_key int, label int, id int, "
    "_hits int, _llm_text int, one int, path int, block int, hits int, url string, html string, contaminated string"
)


def awkward(spark):
    """NULL, empty, blank and very long texts, repeated rows, repeated and NULL ids, columns named like results."""
    rows = [(n, text) for n, text in enumerate(TEXTS)] + [(0, TEXTS[0])] * 2 + [(3, TEXTS[9]), (None, TEXTS[0]), (None, None), (None, TEXTS[6])]
    extra = len(SCHEMA.split(", ")) - 2
    return spark.createDataFrame([(i, t, *[None] * extra) for i, t in rows], SCHEMA)


def nothing(spark):
    return awkward(spark).filter("false")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def documents(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
