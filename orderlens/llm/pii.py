"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score.

Everything is a row-local built-in expression: no shuffle, no Python on the
rows. A kind's matches and the gaps between them come from one expression used
twice (``regexp_extract_all`` and ``split``), so a match begins where the
lengths before it end; positions are code points, ends exclusive.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed rules and are
always reported. Further kinds need their score to reach ``MIN_SCORE``:
``iban`` (its country's length and mod-97), ``card_short`` (13 to 15 digits passing Luhn) and ``ssn``,
the latter two only beside a context word.

Defined results: null and empty texts have no spans; repeated rows and ids are
handled row by row; a null id stays null; other columns are ignored. Matches
that fail a rule are dropped, without another try inside them. Quantifiers are
possessive where that can't change a match, so long runs need no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import digest_of_strings

LOCAL = "[A-Za-z0-9._%+-]"
#: Countries by the length of their IBANs: the registry's, then those in use outside it.
IBAN_COUNTRIES = {n: c.split() for n, c in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items()}
PATTERNS = {
    # begins at the first character of a run, or where the last match ended: other starts can't match
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # as long as the country's IBANs are, so that a word or number behind is no part of it
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
        rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + r")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text must pass to hold a kind at all.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
          "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
BASE = ("email", "ip", "card", "phone")
#: (score of a confirmed match, score added by a context word nearby)
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3),
          "iban": (0.8, 0.2), "card_short": (0.4, 0.4), "ssn": (0.3, 0.5)}
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|whatsapp",
    "iban": r"iban|bank|account|konto|compte|cuenta|transfer",
    "card_short": r"card|visa|master|credit|debit|amex|karte|carte|tarjeta",
    "ssn": r"ssn|social security|taxpayer",
}
MIN_SCORE = 0.7
NEAR = 40  # code points on either side in which a context word counts
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, kind: str) -> Column:
    """Array of (found, start, end) of a pattern's leftmost matches that don't overlap.

    Starts are running sums, taken in blocks so that n matches cost n steps of at most ``BLOCK``.
    """
    pattern = F.lit(PATTERNS[kind])

    def placed(found: Column) -> Column:
        def starts(gap: Column) -> Column:
            steps = F.transform(found, lambda x, i: (F.length(F.get(gap, i)) + F.length(x)).cast("long"))

            def by_blocks(step: Column) -> Column:
                blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")),
                                     lambda b: total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))))

                def from_blocks(block: Column) -> Column:
                    before = F.transform(block, lambda _, b: total(F.slice(block, F.lit(1), b)))

                    def spans(base: Column) -> Column:
                        def span(x: Column, i: Column) -> Column:
                            b = F.floor(i / BLOCK).cast("int")
                            start = (F.get(base, b) + total(F.slice(step, b * BLOCK + 1, i - b * BLOCK))
                                     + F.length(F.get(gap, i)))
                            return let(start, lambda s: F.struct(x.alias("found"), s.alias("start"),
                                                                 (s + F.length(x)).alias("end")))
                        return F.transform(found, span)
                    return let(before, spans)
                return let(blocks, from_blocks)
            return let(steps, by_blocks)
        return let(F.split(text, pattern), starts)

    some = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)))
    return F.coalesce(F.when(text.rlike(GUARDS[kind]), some),
                      F.array().cast("array<struct<found:string,start:bigint,end:bigint>>"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def mod_97(code: Column) -> Column:
    """The remainder of an IBAN: first four characters last, letters as 10 to 35."""
    code = F.regexp_replace(code, " ", "")
    moved = F.split(F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4)), "")
    value = lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55)
    return F.aggregate(moved, F.lit(0), lambda r, c: F.when(c == "", r).otherwise(
        F.when(c < "A", r * 10 + value(c)).otherwise(r * 100 + value(c)) % 97))


def small_parts(x: Column) -> Column:
    """Four numbers of at most 255, with any leading zeros."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x, r"\."), lambda p: let(part(p), lambda v: (F.length(v) < 3) | (
        (F.length(v) == 3) & (v <= "255"))))


CONFIRMED: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": small_parts,
    "card": lambda x: let(digits(x), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)),
    "phone": lambda x: F.length(digits(x)).between(8, 15),
    "iban": lambda x: mod_97(x) == 1,
    "card_short": lambda x: let(digits(x), lambda d: F.length(d).between(13, 15) & F.call_function("luhn_check", d)),
    "ssn": lambda x: ~x.rlike("^(000|666|9)|-00-|-0000$"),
}


def spans_of(text: Column, proposed: Column, kind: str) -> Column:
    """The confirmed matches of a kind as (kind, start, end, found, score)."""
    sure, more = SCORES[kind]

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - NEAR, F.lit(0)).cast("int")
        beside = F.concat_ws(" ", F.substring(text, first + 1, s["start"].cast("int") - first),
                             F.substring(text, s["end"].cast("int") + 1, F.lit(NEAR)))
        score = F.lit(sure) + F.when(F.lower(beside).rlike(CONTEXT[kind]), F.lit(more)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        s["found"].alias("found"), F.round(score, 3).alias("score"))

    found = F.transform(F.filter(proposed, lambda s: CONFIRMED[kind](s["found"])), scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= MIN_SCORE)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): per row the spans by kind, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_t"))
    # proposals once per pattern, in a projection of their own: the short cards share the cards' pattern
    rows = rows.select(id_col, "_t", *(matches(F.col("_t"), k).alias(f"_{k}") for k in PATTERNS))
    source = {**{k: k for k in PATTERNS}, "card_short": "card"}
    kinds = [*BASE, "iban", "card_short", "ssn"]
    return rows.select(id_col, F.concat(*(spans_of(F.col("_t"), F.col(f"_{source[k]}"), k) for k in kinds))
                       .alias("spans"))


def span_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, digest of the base spans, all spans as one string."""
    found = personal_data(docs)
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
                        digest_of_strings(F.transform(base, as_text)).alias("base_sha256"),
                        F.array_join(F.transform(F.col("spans"), as_text), ",").alias("spans"))
