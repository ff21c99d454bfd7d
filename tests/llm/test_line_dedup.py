import hashlib

import numpy as np
import pytest

from orderlens.llm import line_dedup
from orderlens.llm.line_dedup import LineIndex, PerfectHash, line_digest, without_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def owners(docs):
    held = {}
    for r, (i, text) in enumerate(docs):
        for line in set(map(key, (text or "").split("\n"))):
            if len(line) >= 20:
                held.setdefault(line, []).append(i)
    return {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(ids) >= 3}


def brute(docs):
    owner, out = owners(docs), []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x)) is None or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINE = "A line that many documents share, ÀÉ."
DOCS = [(10 + i, f"start {i}\n {LINE}\t\nend\n{LINE.lower()}") for i in range(9)] + [
    (30, LINE.upper()), (31, "x" * 19 + "\n" + "é" * 20), (32, "x" * 19 + "\n" + "é" * 20), (33, "x" * 19 + "\n" + "é" * 20 + " "),
    (None, LINE), (None, "only without an id, twice"), (None, "only without an id, twice"), (None, "only without an id, twice"),
    (18, LINE), (18, LINE), (40, ("many lines in one text " * 2 + "\n") * 5000)]


def test_against_brute_force(docs_of, weird):
    docs = weird + DOCS
    assert sorted(map(tuple, line_digest(docs_of(docs)).collect()), key=str) == brute(docs)
    assert line_digest(docs_of([])).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 500_000])
def test_few_hot_keys(docs_of, monkeypatch, hot):
    """Whatever number of keys every task may hold, the rest is answered by the shards."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SHARD", 50)
    lines = [f"line number {k} of the shared ones" for k in range(12)]
    docs = [(i, "\n".join(lines[:1 + i % 12] + [f"line of document {i} alone"])) for i in range(200)]
    assert sorted(map(tuple, line_digest(docs_of(docs)).collect()), key=str) == brute(docs)


def test_stage_keeps_columns(docs_of):
    docs = docs_of([(*d, 5, "l") for d in DOCS], ("doc_id", "text", "n_chars", "low"), ("long", "string", "long", "string"))
    got = without_lines(docs)
    assert got.columns == docs.columns and got.count() == len(DOCS)
    assert {r.n_chars for r in got.collect() if r.doc_id == 10} == {len("start 0\nend")}


@pytest.mark.parametrize("sf", ["0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, line_digest(docs).collect()), key=str) == want and any(r[2] for r in want)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    built = PerfectHash.build(keys)
    assert built.size == len(keys) and sorted(built.slots(keys)) == list(range(len(keys)))


def test_index_tells_strangers_apart():
    rng = np.random.default_rng(4)
    high, low = rng.integers(-2**63, 2**63, (2, 9000))
    index = LineIndex(high, low, np.full(9000, 7), np.arange(9000), np.ones(9000, bool))
    ids, known = np.arange(9000), np.ones(9000, bool)
    assert not index.drops(high, low, ids, known, 3).any()
    assert index.drops(high, low, ids + 1, known, 3).all() and index.drops(high, low, ids, ~known, 3).all()
    other = rng.integers(-2**63, 2**63, (2, 9000))
    assert not index.drops(*other, ids + 1, known, 3).any()


def test_hot_keys_have_their_own_index(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 3)
    docs = [(i, f"{LINE}\nline of document number {i}\nline of documents {i // 3} in threes") for i in range(300)]
    assert sorted(map(tuple, line_digest(docs_of(docs)).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("min_docs", [256, 300])
def test_counts_reach_min_docs(docs_of, min_docs):
    line = "a line that is in very many documents"
    docs = docs_of([(i, line) for i in range(min_docs)] + [(1000 + i, line + "!") for i in range(min_docs - 1)])
    lost = line_dedup.lost_keys(docs, min_docs=min_docs).collect()
    assert sorted(r["_id"] for r in lost) == list(range(min_docs - 1))  # the largest id keeps it
