import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm.pii import BASE, personal_data, span_digest

BRUTE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, x):
    d = re.sub("[^0-9]", "", x)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BRUTE[k], text or "") if good(k, m.group())]


def row(i, text):
    spans = brute(text)
    return (i, *(sum(s[0] == k for s in spans) for k in BASE),
            hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest())


CASES = ["a@b.c%d@e.f.g-h x@y", "é😀 1.2.3.4.5.6.7.8 0300.1.1.1 255.255.255.0", "4111 1111-1111 1111 and 4111111111111112",
         "+1 (377) 555-0271. +49 30 1234567) +1 2 ++12345678", "a" * 60000 + "@", "1 " * 60000, "." .join("1" * 20000),
         "x@y." + "a." * 30000, "+" + "1-" * 30000, "mail " + " ".join(f"u{i}@h{i}.org" for i in range(3000)),
         "4238397436896688 0000000000000000", "a@b.c@d.e", "@@a@b..c", "١٢٣٤@x.y ７.8.9.1"]


def test_against_brute_force(spark, docs_of, weird):
    rows = weird + [(100 + i, t) for i, t in enumerate(CASES)]
    got = [tuple(r)[:6] for r in span_digest(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted((row(*r) for r in rows), key=str)
    assert span_digest(docs_of([])).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=list("ab1234 .@+-()%é😀5"), max_size=60), min_size=60, max_size=60))
def test_random_texts(docs_of, texts):
    rows = list(enumerate(texts))
    assert sorted(tuple(r)[:6] for r in span_digest(docs_of(rows)).collect()) == sorted(row(*r) for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(row(r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r)[:6] for r in span_digest(docs).collect()) == want
    assert any(r[1] for r in want) and any(r[3] for r in want)


@pytest.mark.parametrize(("text", "kinds"), [
    ("Please pay to IBAN DE89 3704 0044 0532 0130 00 today", ["iban"]),
    ("IBAN DE88 3704 0044 0532 0130 00", []),
    ("amex card 378282246310005", ["card_short"]), ("number 378282246310005", []),
    ("my ssn 123-45-6789.", ["ssn"]), ("part 123-45-6789.", []), ("ssn 666-45-6789", [])])
def test_added_kinds(docs_of, text, kinds):
    spans = personal_data(docs_of([(1, text)])).collect()[0].spans
    assert [s.kind for s in spans if s.kind not in BASE] == kinds
    assert all(text[s.start:s.end] == s.found for s in spans)


@pytest.mark.parametrize(("before", "iban", "after"), [
    ("IBAN ", "DE89 3704 0044 0532 0130 00", " BIC COBADEFFXXX"), ("IBAN: ", "DE89370400440532013000", " COBADEFFXXX"),
    ("", "GB29 NWBK 6016 1331 9268 19", " USD 500"), ("to ", "DE89 3704 0044 0532 0130 00", " 2024"),
    ("REF AB12 ", "DE89 3704 0044 0532 0130 00", " EUR"), ("", "NO93 8601 1117 947", " 12 A"),
    ("", "FR14 2004 1010 0505 0001 3M02 606", " BIC PSSTFRPP"), ("", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", " X"),
    ("", "BE68 5390 0754 7034", " GB29 NWBK 6016 1331 9268 18")])
def test_an_iban_ends_at_its_countrys_length(docs_of, before, iban, after):
    text = before + iban + after
    spans = personal_data(docs_of([(1, text)])).collect()[0].spans
    assert [(s.found, s.start, s.end) for s in spans if s.kind == "iban"] == [(iban, len(before), len(before) + len(iban))]


def test_context_moves_the_score(docs_of):
    near, far = personal_data(docs_of([(1, "call +1 (377) 555-0271"), (2, "see +1 (377) 555-0271")])).orderBy("doc_id").collect()
    assert near.spans[0].score > far.spans[0].score


def test_no_python_in_the_plan(docs_of):
    plan = span_digest(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
