"""Personal data in whole texts, with DataFrame functions only.

Per kind a regular expression proposes spans, a validator (number of digits, Luhn, mod 97) confirms them, and words nearby
raise their score. Everything happens inside a row, so nothing is shuffled. Each expression reads a text in linear time: runs
are possessive, and no match can start inside a run in which an earlier start has failed (a lookbehind, or the end of the
match before).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.llm.columns import without

BEFORE, AFTER = 40, 20  # characters around a match in which context words count
MIN_SCORE = 0.5
SCAN = 128  # spans whose positions are added up in one go

EMPTY = "CAST(array() AS ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT, score: DOUBLE>>)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.char_length(value) <= 3) & (F.concat(F.lit("0"), F.substr(value, F.lit(1), F.lit(3))).cast("int") <= 255)

    return F.forall(F.split(match, r"\."), small)


def luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    digits = _digits(match)
    size = F.char_length(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(digits, size - at + 1, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.when(size.between(13, 19), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def mod_97(match: Column) -> Column:
    """15 to 34 characters that, with the first four moved to the end and letters read as 10 to 35, leave 1 when divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, at: Column) -> Column:
        code = F.ascii(F.substr(moved, at, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    size = F.char_length(plain)
    return F.when(size.between(15, 34), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) == 1).otherwise(F.lit(False))


# Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Numbers of their country's length; where none is known or fits, as many groups of four as follow and a shorter one."""
    known = [
        rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{size // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
        for size, countries in IBAN_LENGTHS.items()
    ]
    other = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """``hint`` must match somewhere in a text for ``pattern`` to be tried; ``base`` kinds stay whatever their score."""

    name: str
    pattern: str
    hint: str
    valid: object
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9,
        "mail|contact|write",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _ip_parts, 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", luhn, 0.8, "card|visa|payment|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.char_length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax"),
    Kind(
        "iban", _iban_pattern(), "[A-Z]{2}[0-9]{2}", mod_97, 0.8,
        "iban|account|bank", base=False,
    ),
    Kind(
        "secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])", "(?i)token|secret|passw|key",
        lambda m: F.char_length(_digits(m)) >= 4, 0.3, "token|secret|passw|key", base=False,
    ),
)
CONTEXT_SCORE = 0.25


def _steps(matches: Column, gaps: Column) -> Column:
    """Per match: the length of the text since the match before, its own, itself, and the text nearby."""
    return F.transform(
        F.sequence(F.lit(1), F.size(matches)),
        lambda i: F.struct(
            F.element_at(gaps, i)["size"].alias("gap"), F.char_length(F.element_at(matches, i)).cast("long").alias("size"),
            F.element_at(matches, i).alias("match"), F.concat(F.element_at(gaps, i)["tail"], F.lit("\n"), F.element_at(gaps, i + 1)["head"]).alias("near"),
        ),
    )


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, n: total + n)


def _block(steps: Column, number: Column) -> Column:
    return F.slice(steps, number * SCAN + 1, F.lit(SCAN))


def _blocks(steps: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SCAN).cast("int"))


def _block_sizes(steps: Column) -> Column:
    """The characters that each block of matches takes, so that positions need not be added up from the first match on."""
    return F.transform(_blocks(steps), lambda b: _sum(F.transform(_block(steps, b), lambda s: s["gap"] + s["size"])))


def _places(steps: Column, sizes: Column) -> Column:
    """(start, end) of every match."""
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)")

    def scan(b: Column) -> Column:
        return F.aggregate(
            _block(steps, b), F.struct(_sum(F.slice(sizes, F.lit(1), b)).alias("at"), empty.alias("places")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["size"]).alias("at"),
                F.concat(acc["places"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end")))).alias("places"),
            ),
        )["places"]

    return F.flatten(F.transform(_blocks(steps), scan))


def _confirmed(kind: Kind, steps: Column, places: Column) -> Column:
    score = lambda s: F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.rlike(s["near"], F.lit(kind.words)), CONTEXT_SCORE).otherwise(0.0))
    found = F.transform(
        F.arrays_zip(steps.alias("step"), places.alias("place")),
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"), x["place"]["start"].alias("start"), x["place"]["end"].alias("end"), score(x["step"]).alias("score"),
            kind.valid(x["step"]["match"]).alias("valid"),
        ),
    )
    kept = F.filter(found, lambda s: s["valid"] if kind.base else s["valid"] & (s["score"] >= MIN_SCORE))
    return F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))


def find_personal_data(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` plus spans: (kind, start, end, score) in code points, end exclusive, by kind in the order of ``kinds``, then start.

    Matches of a kind are leftmost and do not overlap each other; spans of different kinds may. Matches that fail their
    validator are dropped without another try, those of kinds that are not ``base`` also below a score of ``MIN_SCORE``. NULL
    and empty texts have no spans. Every row is treated by itself; an empty table stays empty; a column spans is replaced.
    """
    parts = ("match", "gap", "step", "size", "place", "span")
    own = {kind.name: {part: f"_llm_{part}_{kind.name}" for part in parts} for kind in kinds}
    names = [name for of in own.values() for name in of.values()]

    def next_stage(df: DataFrame, part: str, make, otherwise: str = "NULL") -> DataFrame:
        """A stage of its own, so that what it reads is computed once; only for rows that have matches of the kind."""
        return df.withColumns({
            of[part]: F.when(F.size(of["match"]) > 0, make(name, *[F.col(of[p]) for p in parts[: parts.index(part)]])).otherwise(F.expr(otherwise))
            for name, of in own.items()
        })

    whole, by_name = F.coalesce(F.col(text), F.lit("")), {kind.name: kind for kind in kinds}
    margin = lambda gap: F.struct(
        F.char_length(gap).cast("long").alias("size"), F.lower(F.substr(gap, F.lit(-BEFORE))).alias("tail"), F.lower(F.substr(gap, F.lit(1), F.lit(AFTER))).alias("head")
    )
    df = without(docs, [*names, "spans"]).withColumns({
        own[kind.name]["match"]: F.when(F.rlike(whole, F.lit(kind.hint)), F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0)))
        .otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
        for kind in kinds
    })
    df = next_stage(df, "gap", lambda name, match: F.transform(F.split(whole, by_name[name].pattern, -1), margin))
    df = next_stage(df, "step", lambda name, match, gap: _steps(match, gap))
    df = next_stage(df, "size", lambda name, match, gap, step: _block_sizes(step))
    df = next_stage(df, "place", lambda name, match, gap, step, size: _places(step, size))
    df = next_stage(df, "span", lambda name, match, gap, step, size, place: _confirmed(by_name[name], step, place), EMPTY)
    # A later filter on spans must not pull all stages into itself: it is not pushed below a generator.
    whole_list = F.concat(*[F.col(of["span"]) for of in own.values()])
    return df.select("*", F.explode(F.array(whole_list)).alias("spans")).drop(*names)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest, counts."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
        )
    )
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> dict[str, Column]:
    return {f"n_{kind.name}": F.size(F.filter(spans, lambda s: s["kind"] == kind.name)).cast("long") for kind in kinds if kind.base}


def base_only(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == kind.name for kind in kinds if kind.base]))
