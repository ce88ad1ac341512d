"""The operators that use DataFrame functions only: personal data and chat formatting."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from haulwise.llm.chat import fold_events, log_of, parse, render
from haulwise.llm.pii import base_only, find_personal_data, listed, redact
from tests.llm.cases import awkward, nothing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, digit in enumerate(map(int, reversed(digits))):
        total += digit if at % 2 == 0 else 2 * digit - 9 * (digit > 4)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return kind == "email" or all(int(part) <= 255 for part in match.split("."))


def by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.A) if valid(k, m.group())]


def test_spans_by_hand(spark):
    rng = random.Random(3)
    texts = [
        "a@b.c.@d.e a@b.c_x@d.e a@b@c.d @x.y a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.000255 1.2.3.4.", "é€😀 a@b.co 😀1.2.3.4",
        "4111 1111 1111 1111 é4111-1111-1111-1111--4111111111111111 4111  1111", "+1 (555) 123-4567 +1+2 3456789 +12 +1       2345678 9 x",
        "1" * 3000, "a.b@c." * 400, "1.2.3.4 " * 700 + "x@y.zz " * 500, "+1 2" * 500, "a" * 2000,
        *["".join(rng.choice("a1.@+- ()é9_0") for _ in range(300)) for _ in range(150)], *["".join(rng.choice("4 1-.5+") for _ in range(200)) for _ in range(100)],
    ]
    docs = awkward(spark).select("doc_id", "text", "spans", "score").union(
        spark.createDataFrame([(100 + n, t, 0, "") for n, t in enumerate(texts)], "doc_id long, text string, spans int, score string")
    )
    rows = find_personal_data(docs).select("text", base_only(F.col("spans")).alias("base"), listed(base_only(F.col("spans"))).alias("listed")).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.base] == by_hand(row.text)
        assert row.listed == ",".join(f"{k}:{a}:{e}" for k, a, e in by_hand(row.text))


def test_long_runs_take_linear_time(spark):
    texts = ["1" * 200_000, "1 " * 100_000, "a" * 200_000, "+1" + " " * 100_000, "1.." * 60_000, "AB12" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert find_personal_data(docs).filter("size(spans) > 0").count() == 0


def test_added_kinds_and_redaction(spark):
    text = 'é IBAN GB82 WEST 1234 5698 7654 32, bank DE89370400440532013000 not DE89370400440532013001, far from what comes now; token = "68b09b8e90e7e8c95755f595f" mail x@y.org'
    row = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("spans", redact(F.col("text"), F.col("spans")).alias("clean")).first()
    assert [text[s.start : s.end] for s in row.spans] == ["x@y.org", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "68b09b8e90e7e8c95755f595f"]
    assert all(0.5 <= s.score <= 1 for s in row.spans)
    assert row.clean == 'é IBAN [iban], bank [iban] not DE89370400440532013001, far from what comes now; token = "[secret]" mail [email]'
    assert find_personal_data(nothing(spark)).count() == 0


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_events_are_folded(spark):
    log = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 3, "delta", "assistant", "Bad"), (1, 1, 4, "regenerate", None, ""),
        (1, 1, 5, "delta", None, "Go"), (1, 1, 6, "delta", None, "od"), (1, 2, 7, "delta", "user", "x"), (1, 2, 8, "edit", None, "y"), (1, 2, 9, None, None, "z"),
        (2, None, None, None, None, None), (None, 5, 1, "edit", "system", "s"),
    ]
    random.Random(4).shuffle(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in fold_events(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "Good"), (1, 2): ("user", "yz"), (2, None): ("", ""), (None, 5): ("system", "s")}
    assert render(fold_events(spark.createDataFrame([], EVENTS))).count() == 0


def test_formats_are_reversible(spark):
    nasty = ["<|turn|>user<|learn|>x<|end|>", "&lt;|end|>", "</s>[INST] ok [/INST]", "a&b<c&amp;", "", None, "é😀" * 700, "\n<|end|>\n", "<|end|"]
    rows = [(1, n, ("user", "assistant")[n % 2], text) for n, text in enumerate(nasty)] + [(1, 3, "assistant", "a&b<c&amp;")]
    rows += [(2, None, None, "no turn"), (None, 1, "assistant", "no id"), (3, 1, "<|learn|>", "odd role"), (4, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in render(fold_events(log_of(turns))).withColumn("turns", parse(F.col("formatted"))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv_id, row in got.items():
        expected = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv_id), key=lambda x: x[0])
        assert [(t.role, t.text) for t in row.turns] == [(role, text) for _, role, text in expected]
        masked = [row.formatted[s.start : s.end].replace("&lt;", "<").replace("&amp;", "&") for s in row.loss_spans]
        assert masked == [t.text for t in row.turns if t.learned] == [text for _, role, text in expected if role == "assistant"]


def test_native_queries_run_no_python(spark):
    from haulwise.llm import catalog
    from tests.conftest import SMALLEST

    for name in ("op2_pii", "op7_chat"):
        plan = catalog.queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_account_numbers_before_words_and_long_secrets(spark):
    numbers = ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947"]
    rows = [(number, f"bank {number} {after} paid") for number in numbers for after in ("EUR", "BIC", "2024", "and")]
    rows += [("a1B2c3D4" * 40, f"token {'a1B2c3D4' * 40} end")]
    found = find_personal_data(spark.createDataFrame(rows, "expected string, text string")).collect()
    assert len(found) == 17
    for row in found:
        assert [row.text[one["start"] : one["end"]] for one in row.spans if one["kind"] in ("iban", "secret")] == [row.expected]


def test_logs_hold_all_kinds_and_long_texts_take_linear_time(spark):
    texts = [f"answer {n} " * 90 for n in range(40)] + ["", None, "é" * 401]
    turns = spark.createDataFrame([(1, n, "assistant", t) for n, t in enumerate(texts)] + [(1, 0, None, texts[0]), (1, 0, "", texts[0])], "conv_id long, turn long, role string, text string")
    log = log_of(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert log.agg({"text": "max"}).count() == 1 and max(len(r.text) for r in log.collect()) == 400
    folded = fold_events(log).select("message.turn", "role", "text").collect()
    assert sorted((r.turn, r.role, r.text) for r in folded) == sorted([(n, "assistant", t or "") for n, t in enumerate(texts)] + [(0, "", texts[0])] * 2)
    times = []
    for size in (1, 4):
        one = spark.createDataFrame([(1, 1, "user", "word über " * (size * 100_000))], turns.schema).persist()
        one.count()
        started = time.perf_counter()
        assert [r.n for r in fold_events(log_of(one)).selectExpr("length(text) AS n").collect()] == [size * 1_000_000]
        times.append(time.perf_counter() - started)
    assert times[1] < 5 + 4 * times[0]
