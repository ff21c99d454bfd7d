import random
import zlib

import numpy as np
import pytest

from orderlens.llm import classifier
from orderlens.llm.classifier import FEATURES, RANK, Machine, features, fitted, joined, quality_scores, trained

TYPES = (("doc_id", "text", "n_chars", "score", "held_out"), ("long", "string", "long", "string", "int"))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, score double")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = Machine(rng.normal(size=FEATURES), rng.normal(size=(FEATURES, RANK)))
    rows = [features(t, n) for t, n in (("a few words, a few", 18), ("", None), (None, 0), ("!!! ### A\nA\nA", 1 << 62))]
    got = model.margins(*joined(rows))[0]
    for (places, values), g in zip(rows, got, strict=True):
        want = model.w[places] @ values
        for i in range(len(places)):
            for j in range(i):
                want += model.v[places[i]] @ model.v[places[j]] * values[i] * values[j]
        assert g == pytest.approx(want)
        assert len(set(places.tolist())) == len(places) and places.max() < FEATURES


def test_pairs_are_learnt():
    """Good if exactly one of two words occurs: no sum of single weights tells that."""
    rng = random.Random(4)
    texts = [" ".join([*rng.sample(["left", "right"], rng.choice([0, 1, 2])), "common"]) for _ in range(600)]
    good = np.array([float(("left" in t) != ("right" in t)) for t in texts])
    rows = [(p[p < classifier.WORDS], v[p < classifier.WORDS]) for p, v in (features(t, None) for t in texts)]
    model = trained(rows, good, np.ones(len(rows)), rounds=60)
    assert (((model.scores(rows) >= 0.5) == (good == 1)).mean()) > 0.98


def test_odd_rows(spark, docs_of, weird):
    rows = [(i, t, None if i == 4 or k % 2 else len(t or ""), "x", 7) for k, (i, t) in enumerate(weird * 2)]
    rows += [(100 + i, "good words in a plain order here" if i % 2 else "### *** !!! $$$ ###", -5, None, None) for i in range(200)]
    labels = [(100 + i, i % 2, 0.0) for i in range(200)] + [(101, 1, 0.0), (None, 1, 0.0), (7000, 0, 0.0), (3, None, 0.0)]
    got = quality_scores(docs_of(rows, *TYPES), labels_of(spark, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id >= 100)
    same = {}
    assert all(same.setdefault(r.doc_id, r.score) == r.score for r in got if r.doc_id == 4)
    again = quality_scores(docs_of(rows, *TYPES).repartition(3), labels_of(spark, labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_labels_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "text", 4, "", 0)], *TYPES)
    assert [r.score for r in quality_scores(docs, labels_of(spark, [])).collect()] == [0.5]
    assert quality_scores(docs_of([], *TYPES), labels_of(spark, [(1, 1, 0.0)])).count() == 0
    one = quality_scores(docs_of([(i, "text", 4, "", 0) for i in range(20)], *TYPES), labels_of(spark, [(i, 1, 0.0) for i in range(20)]))
    assert all(r.predicted == 1 for r in one.collect())


def test_held_out_labels_and_metadata_of_the_row_never_count(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", classifier.F.when(classifier.remainder(labels.doc_id) == 0, 1 - labels.quality)
                                .otherwise(labels.quality))
    other = docs.withColumn("lang", classifier.F.lit("xx")).withColumn("source", classifier.F.lit(None).cast("string"))
    a = sorted(map(str, quality_scores(docs, labels).collect()))
    assert a == sorted(map(str, quality_scores(other, flipped).collect()))


def area(scores, good):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    n = good.sum()
    return (order[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality = {}
    for r in labels.collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    rows = [r for r in quality_scores(docs, labels).collect() if r.held_out and r.doc_id in quality]
    scores, good = np.array([r.score for r in rows]), np.array([quality[r.doc_id] == 1 for r in rows])
    right = np.array([r.predicted == 1 for r in rows]) == good
    print(sf, len(rows), "accuracy", right.mean(), "area", area(scores, good))
    assert right.mean() > 0.93 and right[good].mean() > 0.97 and area(scores, good) > 0.95


def test_sample_is_bounded(spark, docs_of):
    docs = docs_of([(i, f"word{i % 3} " * 5, 1, "", 0) for i in range(300)], *TYPES)
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0.0) for i in range(300)])
    seen = []
    real = classifier.trained
    classifier.trained = lambda rows, good, weight, **kw: seen.append((len(rows), good.sum(), weight)) or real(rows, good, weight, **kw)
    try:
        fitted(docs, labels, max_rows=40)
    finally:
        classifier.trained = real
    n, good, weight = seen[0]
    assert n == 40 and good == 20 and len(set(weight.round(9))) == 2
