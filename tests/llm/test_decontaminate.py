import hashlib
import re

import pytest

from orderlens.llm.decontaminate import clean_documents, contamination, occurrences, without_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    runs = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if n else ():
            runs.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths = {len(r) for r in runs}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (r := tuple(w[p:p + n])) in runs:
                    hit.update(range(p, p + n))
                    found |= runs[r]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "SHORT item"), (10, "short ITEM"),
         (3, None), (4, ""), (5, "éÉ ÀB"), (None, "no id here"), (2, "short item"), (6, "two three " * 8)]
DOCS = [(20, "zero one two three four five six seven eight nine ten, eleven twelve"), (21, "short-item short item"),
        (22, "éÉ àb ÉÉ Àb éÉ àB éÉ ÀB"), (23, "two three " * 40), (24, "one two three four five six seven eight nine"),
        (25, "no id here " * 3), (26, "x " * 20000 + "short item")]


@pytest.fixture()
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(docs_of, items_of, weird):
    docs = weird + DOCS + DOCS[:2]
    got = contamination(docs_of(docs), items_of(ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ITEMS)


def test_shuffle_join_gives_the_same(docs_of, items_of):
    docs, items = docs_of(DOCS), items_of(ITEMS)
    a = occurrences(docs, items).drop("hits").collect()
    b = occurrences(docs, items, max_broadcast=0).drop("hits").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_tables(docs_of, items_of):
    assert contamination(docs_of([]), items_of(ITEMS)).count() == 0
    got = contamination(docs_of(DOCS), items_of([])).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, [])


def test_modes(docs_of, items_of, weird):
    docs = docs_of([(*d, "x", "y") for d in weird + DOCS], ("doc_id", "text", "n", "_w"), ("long", "string", "string", "string"))
    kept = clean_documents(docs, items_of(ITEMS))
    want = [r for r in brute(weird + DOCS, ITEMS) if not r[-1]]
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want)
    spans = {r.doc_id: r.kept_words for r in without_spans(docs_of(DOCS), items_of(ITEMS)).collect()}
    assert spans[20] == ["zero", "twelve"] and spans[21] == [] and spans[24] == words(DOCS[4][1])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    got = contamination(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[-1] for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
