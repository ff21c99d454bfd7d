import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm.mixing import best_counts, mix

WEIGHTS = (5, 2, 1)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= above
    return target


def check(rows, got, slack=4096):
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    want, taken = brute_targets(size), dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert sorted((str(r.row.doc_id), r["size"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    return {s: want[s] - taken[s] for s in size}


TYPES = (("doc_id", "text", "source"), ("long", "string", "string"))


def test_small_tables(spark, docs_of, weird):
    rows = [(i, t, ["b", "a", None, "é", "Z"][k % 5]) for k, (i, t) in enumerate(weird * 3)]
    rows += [(100 + i, "w " * (i % 17), ["b", "a", None, "é", "Z"][i % 5]) for i in range(300)]
    docs = docs_of(rows, *TYPES)
    got = mix(docs).collect()
    missed = check(rows, got)
    assert all(-1e-6 < d <= 30_000 for d in missed.values())  # the largest document
    again = mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(docs_of([], *TYPES)).count() == 0
    check(rows[:3], mix(docs_of(rows[:3], *TYPES)).collect())


def test_targets_are_met_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    missed = check(rows, mix(docs).collect())
    assert all(0 <= d + 1e-6 and (d < 1 + 1e-6 or d == pytest.approx(least_miss(rows, s, d))) for s, d in missed.items()), missed


def least_miss(rows, source, missed):
    """How near any choice of 0 to 2 copies of the source's documents comes to its target, by all sums that there are."""
    sizes = [len((t or "").split()) for _, t, s in rows if s == source]
    return least_miss_of(sizes, brute_targets(source_sizes(rows))[source])


def least_miss_of(sizes, target):
    reach = 1
    for n in sizes:
        reach |= reach << n
        reach |= reach << n
    return target - ((reach & ((1 << int(target) + 1) - 1)).bit_length() - 1)


def source_sizes(rows):
    out = {}
    for _, text, source in rows:
        out[source] = out.get(source, 0) + len((text or "").split())
    return out


def test_one_size_holds_everything(spark, docs_of):
    rows = [(i, "a b c", "s") for i in range(9000)] + [(9000 + i, "x", "t") for i in range(9000)]
    got = mix(docs_of(rows, *TYPES)).collect()
    assert all(-1e-6 <= d < 3 for d in check(rows, got).values())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 60),
       st.sampled_from([0, 5, 1000]))
def test_best_counts(table, budget, enough):
    sizes, counts = list(table), list(table.values())
    taken = best_counts(sizes, counts, budget, enough)
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    got = sum(s * t for s, t in zip(sizes, taken, strict=True))
    assert got <= budget
    sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(n + 1) for n in counts))}
    best = max(x for x in sums if x <= budget)
    if enough >= budget:
        assert got == best  # the knapsack alone: exactly the best sum
    assert best - got <= max(sizes)
