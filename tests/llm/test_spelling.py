import random
import re
import zlib

import numpy as np
import pytest

from orderlens.llm import spelling
from orderlens.llm.spelling import near_words, variants


def brute_words(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute_near(words):
    """Near words by the masks that two words share."""
    masks, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1:]), set()).add(w)  # replaced
        for i in range(len(w)):
            if (shorter := w[:i] + w[i + 1:]) in near:  # deleted, and the other way inserted
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(docs):
    count = brute_words(docs)
    near, form = brute_near(count), {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            if count[best] >= 10 * count[w]:
                form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), count[form[w]] if w in form else None, root))
    return sorted(out)


def text_of(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "é", "And", "ñí", "×a", "re", "st"]) for _ in range(rng.randrange(1, 7)))
                    for _ in range(n))


def fixture():
    rng = random.Random(5)
    common = ["Nachbarschaft", "ÉTATSUNIS", "neighbour", "neighbours", "abababab", "babababa"]
    docs = [(i, text_of(rng, rng.randrange(200)) + " " + " ".join(rng.choices(common, k=30))) for i in range(300)]
    docs += [(400 + i, w) for i, w in enumerate(["neighbur", "neighbuor", "neigbour", "neigbbour", "neigbbbour"] * 3)]
    docs += [(500 + i, w + " end") for i, w in enumerate(["colourful"] * 500 + ["colourfull"] * 40 + ["colourfulll"] * 3)]
    return docs + [(2000, "q" * 400 + " " + "q" * 401 + " " + "q" * 399 + "é")] * 2


def test_against_brute_force(docs_of, weird):
    docs = fixture() + weird + weird[:4]
    got = sorted(map(tuple, variants(docs_of(docs)).collect()))
    want = brute(docs)
    assert got == want
    assert any(r[3] for r in want) and any(r[5] != r[0] and r[5] != r[3] for r in want)  # chains of forms


def test_split_lengths_and_crowded_cells(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 20)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    monkeypatch.setattr(spelling, "LEAF", 2)
    docs = fixture()
    boxes = spelling.cells_of(spelling.vocabulary(docs_of(docs)))
    assert any(len(b) > 4 for b in boxes.values())
    assert sorted(map(tuple, variants(docs_of(docs)).collect())) == brute(docs)


def test_many_words_of_the_same_letters(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 30)
    rng = random.Random(2)
    words = ["".join(rng.sample("aabbccdd", 8)) for _ in range(400)]
    docs = [(i, " ".join(words) + " aabbccddx") for i in range(3)]
    assert sorted(map(tuple, variants(docs_of(docs)).collect())) == brute(docs)


def test_empty_tables(docs_of):
    assert variants(docs_of([])).count() == 0
    assert variants(docs_of([(1, None), (2, ""), (None, "once upon")])).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, variants(docs).collect())) == want and any(r[3] for r in want)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéñ×öz"])
def test_near_words(letters):
    rng = random.Random(len(letters))
    for longer in (False, True):
        points = list({"".join(rng.choice(letters) for _ in range(8)) for _ in range(300)})
        queries = list({"".join(rng.choice(letters) for _ in range(8 - longer)) for _ in range(200)})
        near = brute_near({*points, *queries})
        want = {(q, p) for q in queries for p in points if p in near[q]}
        found = [(queries[a], points[b]) for x, y in near_words(points, queries, longer) for a, b in zip(x, y, strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def test_letter_counts():
    got = spelling.letter_counts(["abca", "zé", "ÀÆ"])
    assert got.sum(axis=1).tolist() == [4, 2, 2] and got[0, :3].tolist() == [2, 1, 1]
    assert (np.abs(got[1] - got[2]).sum()) == 4 or got[2].max() == 2
