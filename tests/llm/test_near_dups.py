import random
import re
from itertools import combinations

import numpy as np

from orderlens.llm import near_dups
from orderlens.llm.near_dups import component_rows, one_of_each, shingles, signature, survivors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    holds = {}
    for r, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(r)
    common = {}
    for rows in holds.values():
        for p in combinations(rows, 2):
            common[p] = common.get(p, 0) + 1
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for (x, y), n in common.items():
        if 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n):
            up[top(x)] = top(y)
    low = {}
    for r, (i, _) in enumerate(docs):
        if i is not None:
            low[top(r)] = min(low.get(top(r), i), i)
    out = []
    for r, (i, _) in enumerate(docs):
        c = low.get(top(r)) if sets[r] else i
        out.append((i, len(sets[r]), c, i == c))
    return sorted(out, key=str)


def near_copies(seed, n, words=60, changes=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def fixture():
    texts = [t for k in range(25) for t in near_copies(k, 8)]
    texts += near_copies(99, 150, 80, 2) + ["Same Text here for all\tof them"] * 40 + ["a b", "A  b", "a", "b c d e"]
    rng = random.Random(5)
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_against_brute_force(docs_of, weird):
    docs = weird + fixture()
    docs = [(i if k < len(weird) else i + 100, t) for k, (i, t) in enumerate(docs)]
    want = brute(docs)
    assert sorted(map(tuple, component_rows(docs_of(docs)).collect()), key=str) == want
    kept = one_of_each(docs_of([(*d, 1, 2) for d in docs], ("doc_id", "text", "node", "_hash"), ("long", "string", "int", "int")))
    assert kept.columns == ["doc_id", "text", "node", "_hash"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[3])


def test_blocks_of_one_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    docs = [(i, t) for i, t in enumerate(near_copies(1, 40, 30, 1) + near_copies(2, 40, 30, 2))]
    assert sorted(map(tuple, component_rows(docs_of(docs)).collect()), key=str) == brute(docs)


def test_blocks_by_bytes(docs_of, monkeypatch):
    """Long members make blocks of few; one set beyond the limit is still compared."""
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 4000)
    texts = near_copies(3, 12, 900, 40) + near_copies(4, 30, 60, 4) + near_copies(5, 3, 3000, 100)
    docs = list(enumerate(texts))
    assert sorted(map(tuple, component_rows(docs_of(docs)).collect()), key=str) == brute(docs)


def test_rows_of_a_large_bucket(spark, docs_of, monkeypatch):
    """A bucket four times as large makes at most eight times the rows; no join makes more rows than there are members."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rows = {}
    for n in (256, 1024):
        members = spark.range(n).selectExpr("1L bucket", "0 band", "id node", "id label", f"{n}L n")
        rows[n] = near_dups.in_blocks(members, near_dups.block_count(members["n"])).count()
    assert rows == {256: 256 * 8, 1024: 1024 * 16}

    dealt, plain = [], near_dups.in_blocks

    def counted(members, blocks):
        dealt.append((members.count(), "sig" in members.columns))
        return plain(members, blocks)

    monkeypatch.setattr(near_dups, "in_blocks", counted)
    docs = list(enumerate(near_copies(7, 120, 40, 4)))
    assert sorted(map(tuple, component_rows(docs_of(docs)).collect()), key=str) == brute(docs)
    assert len(dealt) == 2 and all(with_sig and n <= 120 * near_dups.BANDS for n, with_sig in dealt)


def test_only_survivors_bring_their_sets(docs_of, monkeypatch):
    """Texts on a template, far below the similarity, fill buckets; hardly any set is fetched for them."""
    rng, asked = random.Random(6), []
    frame = [f"t{k}" for k in range(60)]
    texts = [" ".join(frame + [f"o{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(300)]
    docs = list(enumerate(texts))
    plain = near_dups.sets_of

    def counted(nodes, *rest):
        asked.append(nodes.distinct().count())
        return plain(nodes, *rest)

    monkeypatch.setattr(near_dups, "sets_of", counted)
    monkeypatch.setattr(near_dups, "BLOCK", 50)
    assert sorted(map(tuple, component_rows(docs_of(docs)).collect()), key=str) == brute(docs)
    assert asked[1] < 60


def test_empty_tables(docs_of):
    assert component_rows(docs_of([])).count() == 0
    got = component_rows(docs_of([(1, ""), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, component_rows(docs).collect()), key=str) == want and any(not r[3] for r in want)


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    for share in (0.3, 0.75, 0.9):
        same = [str(rng.random()).encode() for _ in range(round(400 * share))]
        sides = [same + [str(rng.random()).encode() for _ in range((400 - len(same)) // 2)] for _ in range(2)]
        a, b = (signature(np.unique(np.concatenate([shingles([w]) for w in s]))) for s in sides)
        assert abs((a == b).mean() - share) < 0.15
        assert len(survivors(a[None], b[None])) == (share >= 0.75)
