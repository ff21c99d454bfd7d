import hashlib
import random

import numpy as np
import pytest

from orderlens.llm import suffix_dedup
from orderlens.llm.suffix_dedup import LENGTH, PLACES, lost_places, removal_digest, runs_in, runs_of, suffix_places


def brute(docs):
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - LENGTH + 1):
            k = b[p:p + LENGTH]
            o = float("inf") if i is None else i
            if first.get(k, float("inf")) >= o:
                first[k] = o
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone, end, spans, kept = 0, 0, 0, bytearray()
        mark = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p:p + LENGTH]] < (float("inf") if i is None else i):
                mark[max(p, end):p + LENGTH] = b"\1" * (p + LENGTH - max(p, end))
                end = p + LENGTH
        for k, m in enumerate(mark):
            gone += m
            spans += m and not (k and mark[k - 1])
            if not m:
                kept.append(b[k])
        out.append((i, len(b), gone, spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["un", "of", "thé", "é", "and", "xylo", "ra", "qu"]) + rng.choice("abcdeé") for _ in range(n))
    shared = [text(60), text(9)[:49], "z" * 300, "ab" * 100, text(12)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(3, 40)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        parts.insert(rng.randrange(4), shared[0][rng.randrange(30):])
        docs.append((i * 7 % 61, rng.choice(["", "\n"]).join(parts)))
    docs += [(300 + k, "q" * (LENGTH + k) + "r" * 30) for k in (61, 62, 63, 64, 65)] + [(310, "q" * 200)]   # runs of any length
    return docs + [(100 + i, docs[3][1]) for i in range(20)] + [(None, docs[4][1]), (None, docs[4][1]), (200, docs[5][1]), (200, docs[5][1])]


def test_against_brute_force(docs_of, weird):
    docs = weird + fixture()
    assert sorted(map(tuple, removal_digest(docs_of(docs)).collect()), key=str) == brute(docs)


def test_crowded_keys_and_small_shards(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD", 500)
    docs = fixture()
    assert sorted(map(tuple, removal_digest(docs_of(docs)).collect()), key=str) == brute(docs)


def test_many_equal_rows(docs_of):
    """Rows of equal id and text are sorted once, so their number costs no more than their length."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdef", k=7)) for _ in range(500))
    docs = [(1, text)] + [(2, text)] * 5000 + [(None, text)] * 5000 + [(3, text[100:] + " end")] * 100
    got = removal_digest(docs_of(docs).repartition(7)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count()
    sizes = {tuple(r)[:5]: r["count"] for r in got.collect()}
    want = brute([(1, text), (2, text), (3, text[100:] + " end"), (None, text)])
    assert sorted(sizes, key=str) == want and sorted(sizes.values()) == [1, 100, 5000, 5000]


def test_long_text(docs_of):
    rng = random.Random(8)
    words = [text_word(rng) for _ in range(30_000)]
    docs = [(7, " ".join(words)), (3, " ".join(words[1000:1400])), (9, " ".join(words[20_000:20_050] + words[5:9]))]
    assert sorted(map(tuple, removal_digest(docs_of(docs)).collect()), key=str) == brute(docs)


def text_word(rng):
    return rng.choice(["un", "of", "thé", "é", "and", "xylo"]) + "".join(rng.choices("abcdeé", k=rng.randrange(5)))


def test_clashing_columns(spark):
    docs = [(1, "x" * 80, 5, "k", 0), (2, "y" + "x" * 80, 6, "k", 1), (None, None, None, None, None)]
    names = "doc_id long, text string, _order int, key string, start int"
    whole = suffix_dedup.without_repeats(spark.createDataFrame(docs, names))
    assert sorted((r.row._order or 0, r.n_removed) for r in whole.collect()) == [(0, 0), (5, 0), (6, 80)]


def test_empty_tables(docs_of):
    assert removal_digest(docs_of([])).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in removal_digest(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0, empty)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, removal_digest(docs).collect()), key=str) == want and any(r[2] for r in want)


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array_order(letters):
    rng = random.Random(letters)
    for _ in range(100):
        s = np.array([rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 150))])
        place = suffix_places(s)
        starts = [tuple(s[i:i + LENGTH]) for i in range(len(s))]
        assert [starts[i] for i in np.argsort(place, kind="stable")] == sorted(starts)
        by = {}
        for i, r in enumerate(place):
            assert by.setdefault(r, starts[i]) == starts[i]


def test_lost_places():
    rng = random.Random(2)
    base = bytes(rng.randrange(256) for _ in range(400))
    cuts = [base[i:i + rng.randrange(50, 50 + PLACES)] for i in range(0, 300, 17)] + [b"\0" * 80, b"\0" * 60, b"\0" * 49]
    first = np.array([rng.randrange(5) for _ in cuts])
    least = {}
    for c, f in zip(cuts, first, strict=True):
        for i in range(len(c) - LENGTH + 1):
            least[c[i:i + LENGTH]] = min(least.get(c[i:i + LENGTH], 9), f)
    want = [sum(1 << i for i in range(len(c) - LENGTH + 1) if least[c[i:i + LENGTH]] < f) for c, f in zip(cuts, first, strict=True)]
    assert lost_places(cuts, first).tolist() == want


def test_runs_cover_every_place():
    rng = random.Random(3)
    for n in (0, 49, 50, 51, 500, 3000):
        text = bytes(rng.choice(b"ab") for _ in range(n)) + b"q" * n
        key, start, places = runs_of(text)
        assert sum(places) == max(0, len(text) - LENGTH + 1) and all(0 < p <= PLACES for p in places)
        assert [i for s, p in zip(start, places, strict=True) for i in range(s, s + p)] == list(range(sum(places)))


def test_runs_of_texts_at_once():
    """Texts told together have the runs that each has alone, and equal cuts equal hashes."""
    rng = random.Random(12)
    texts = [bytes(rng.choices(b"abcd ", k=n)) for n in (0, 300, 49, 50, 0, 0, 51, 10, 1200)] + [b"ab" * 400, b"", b"x" * 49]
    texts += [texts[1], b"q" + texts[8]]
    owner, key, cut_hash, start, places = runs_in(texts)
    at, seen = 0, {}
    for t, text in enumerate(texts):
        alone = runs_of(text)
        mine = slice(at, at + len(alone[0]))
        at = mine.stop
        assert (owner[mine] == t).all()
        for got, want in zip((key, start, places), alone, strict=True):
            assert got[mine].tolist() == want.tolist()
        for h, i, n in zip(cut_hash[mine].tolist(), *(x.tolist() for x in alone[1:]), strict=True):
            assert seen.setdefault(h, text[i:i + n + LENGTH - 1]) == text[i:i + n + LENGTH - 1]
    assert at == len(owner) and len(set(seen.values())) == len(seen)


def test_only_strings_that_can_repeat_are_sorted(monkeypatch):
    """Cuts that share no string don't reach the suffix array; the verdicts are those of comparing all strings."""
    sorted_bytes, plain = [], suffix_dedup.suffix_places

    def counted(s, depth=0):
        if not depth:
            sorted_bytes.append(len(s))
        return plain(s, depth)

    monkeypatch.setattr(suffix_dedup, "suffix_places", counted)
    rng = random.Random(13)
    word = lambda k: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=k))
    middle, common, ends = word(16), word(60), (word(8), word(8))
    cuts = [word(30) + middle + word(30) for _ in range(200)] + [word(20) + common + word(5), common + word(30)]
    cuts += [ends[0] + word(34) + ends[1] for _ in range(2)]  # alike at both ends alone
    first = np.array([rng.randrange(1000) for _ in cuts])
    first[200:204] = 7, 5, 3, 4
    want = []
    for c, f in zip(cuts, first, strict=True):
        strings = [c[i:i + LENGTH] for i in range(len(c) - LENGTH + 1)]
        want.append(sum(1 << i for i, x in enumerate(strings) if any(x in d and g < f for d, g in zip(cuts, first, strict=True))))
    assert lost_places(cuts, first).tolist() == want and want[200] and not want[201]
    assert sum(sorted_bytes) <= 2 * 61 + 2 * 51
