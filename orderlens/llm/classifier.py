"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its words' hashes with damped counts (of length 1 together), structure statistics as
numbers and as their steps, the stored ``n_chars`` as a step (metadata), and a constant. Its score is the logistic of

    sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features count, through ``RANK`` factors each, in time linear in the number of features.

Fitting: of the labelled documents whose ``crc32(doc_id as text) mod 5`` isn't 0, the ``max_rows`` with the smallest
seeded hashes are taken, half of them at most from one class; rows are weighted back to the classes' true shares.
``max_rows`` is the bound of the sample, and a document has at most ``FEATURES`` features, so the driver's part is
bounded whatever the input; everything else covers all documents. Scoring is one pass without a shuffle; the model
(``FEATURES`` x (``RANK`` + 1) numbers) goes to every task.

Labels, language, source and id are no features. Texts are read whole.

Defined results: null and empty texts have the constant, their statistics and no words, and get a score like others; a
null ``n_chars`` (or a missing column) is a step of its own; a null id counts as the empty text in the crc32, so it is
held out; of repeated labels the worst counts, null labels don't; rows with one id share its label and the one with the
smallest text hash is learnt from; with no label to learn from every score is 0.5; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import written

WORDS, RANK, FOLDS = 1 << 12, 8, 5
STEPS = 12  # of a statistic
STATISTICS = ("words", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "punctuation", "high_bytes",
              "repeated_lines", "short_lines", "repeated_pairs", "distinct", "commonest", "ends_in_symbol")
FIRST_STATISTIC = WORDS
FIRST_STEP = FIRST_STATISTIC + len(STATISTICS)
FIRST_SIZE = FIRST_STEP + len(STATISTICS) * STEPS
CONSTANT = FIRST_SIZE + 66
FEATURES = CONSTANT + 1
BYTES = {"symbols": b"#*$%&<>", "bars": b"|", "bangs": b"!", "digits": b"0123456789", "punctuation": b".,;:?'\"()-",
         "capitals": bytes(range(65, 91)), "high_bytes": bytes(range(128, 256))}
SYMBOL_END = re.compile(rb"[#*$%&|<>!]")


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The structure statistics, each from 0 to 1."""
    n, size = max(1, len(words)), max(1, len(text))
    share = {k: (len(text) - len(text.translate(None, b))) / size for k, b in BYTES.items()}
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    values = {
        **share, "words": min(1.0, math.log1p(len(words)) / 12), "word_length": min(1.0, sum(map(len, words)) / n / 20),
        "repeated_lines": 1 - len(set(lines)) / m, "short_lines": sum(len(x) < 30 for x in lines) / m,
        "repeated_pairs": 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, "distinct": len(counts) / n,
        "commonest": max(counts.values(), default=0) / n,
        "ends_in_symbol": sum(c for w, c in counts.items() if SYMBOL_END.match(w, len(w) - 1)) / n}
    return [values[k] for k in STATISTICS]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a document's features; a place may occur once only."""
    data = (text or "").encode()
    words = data.split()  # on the bytes 9 to 13 and 32
    counts = Counter(words)
    folded: dict[int, int] = {}
    for w, c in counts.items():
        place = zlib.crc32(w.lower()) % WORDS
        folded[place] = folded.get(place, 0) + c
    places = np.fromiter(folded, np.int64, len(folded))
    values = np.log1p(np.fromiter(folded.values(), float, len(folded)))
    if len(values):
        values /= np.sqrt(values @ values)
    stats = statistics(data, words, counts)
    steps = [min(STEPS - 1, int(math.log2(1 + 2047 * s))) for s in stats]
    size = 65 if n_chars is None else min(64, max(0, int(n_chars)).bit_length())
    more = [*range(FIRST_STATISTIC, FIRST_STEP), *(FIRST_STEP + i * STEPS + s for i, s in enumerate(steps)), FIRST_SIZE + size, CONSTANT]
    rest = [*stats, *([0.5] * len(steps)), 0.5, 1.0]
    return np.concatenate([places, np.array(more)]), np.concatenate([values, np.array(rest)])


@dataclass
class Machine:
    """The factorisation machine's weights ``w`` and factors ``v``."""
    w: np.ndarray
    v: np.ndarray

    def margins(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, factor sums) per document; documents begin at ``starts`` of the joined features."""
        part = self.v[places] * values[:, None]
        sums = np.add.reduceat(part, starts)
        pairs = (sums * sums - np.add.reduceat(part * part, starts)).sum(axis=1) / 2
        return np.add.reduceat(self.w[places] * values, starts) + pairs, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return logistic(self.margins(*joined(rows))[0]) if rows else np.zeros(0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p, _ in rows])
    return np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def trained(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray, rounds: int = 12, batch: int = 64,
            rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Weighted logistic loss by adaptive gradient steps over seeded batches."""
    rng = np.random.default_rng(seed)
    model = Machine(np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    past_w, past_v = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            some = order[k:k + batch]
            places, values, starts = joined([rows[i] for i in some])
            margin, sums = model.margins(places, values, starts)
            slope = (logistic(margin) - good[some]) * weight[some] / len(some)
            of = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(places))))
            at, back = np.unique(places, return_inverse=True)
            own = slope[of] * values
            grad_w = np.bincount(back, own, len(at)) + decay * model.w[at]
            each = own[:, None] * (sums[of] - model.v[places] * values[:, None])
            grad_v = np.stack([np.bincount(back, each[:, f], len(at)) for f in range(RANK)], axis=1) + decay * model.v[at]
            past_w[at] += grad_w ** 2
            past_v[at] += grad_v ** 2
            model.w[at] -= rate * grad_w / np.sqrt(past_w[at])
            model.v[at] -= rate * grad_v / np.sqrt(past_v[at])
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def size_of(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, seed: int = 5) -> Machine:
    """The machine learnt from a sample of at most ``max_rows`` labelled documents that aren't held out."""
    labelled = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0))
                .groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).cast("int").alias("_good")))
    there = docs.select(F.col("doc_id").alias("_id"))
    labelled = written(labelled.join(there, "_id", "left_semi"), "classifier-labels")
    sizes = dict(labelled.groupBy("_good").count().collect())
    if not sizes:
        return Machine(np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    most = max_rows // 2
    order = [F.xxhash64(F.lit(seed), "_id"), F.col("_id")]
    sample = labelled.filter("_good = 0").orderBy(*order).limit(most).unionByName(
        labelled.filter("_good = 1").orderBy(*order).limit(most))
    sample = F.broadcast(written(sample, "classifier-sample"))  # at most max_rows rows of two numbers
    rows = docs.select(F.col("doc_id").alias("_id"), "text", size_of(docs).alias("_size")).join(sample, "_id")
    rows = rows.groupBy("_id", "_good").agg(F.min_by(F.struct("text", "_size"), F.xxhash64("text", "_size")).alias("r"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, good, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, values = features(text, size)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([good], pa.int32()),
                                                  pa.array([places.astype(np.int32)], pa.list_(pa.int32())),
                                                  pa.array([values], pa.list_(pa.float64()))], ["_id", "good", "places", "values"])

    found = rows.select(F.col("_id").cast("long").alias("_id"), "_good", "r.text", "r._size").mapInArrow(
        listed, "_id long, good int, places array<int>, values array<double>").toArrow().sort_by("_id").combine_chunks()
    good = found["good"].to_numpy().astype(float)
    taken = {g: max(1, int((good == g).sum())) for g in sizes}
    weight = np.array([sizes[int(g)] / taken[int(g)] for g in good])
    parts = [(np.asarray(p.values, np.int64), np.asarray(v.values))
             for p, v in zip(found["places"], found["values"], strict=True)]
    return trained(parts, good, weight / weight.mean(), seed=seed)


def scored(docs: DataFrame, model: Machine, floor: float = 0.3) -> DataFrame:
    """(row, held_out, score, predicted): every row of ``docs`` whole in ``row``."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("_t"), size_of(docs).alias("_size"),
                       (remainder(F.col("doc_id")) == 0).alias("held_out"))

    @F.pandas_udf("double")
    def score(texts, sizes):  # noqa: ANN001, ANN202 - pandas series
        import pandas as pd
        out = [model.scores([features(t, None if pd.isna(n) else int(n)) for t, n in zip(texts[k:k + 256], sizes[k:k + 256], strict=True)])
               for k in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    rows = rows.withColumn("score", score("_t", "_size"))
    return rows.select("row", "held_out", "score", (F.col("score") >= floor).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    cols = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    docs = docs.select(*cols)
    return scored(docs, fitted(docs, labels)).select("row.doc_id", "held_out", "score", "predicted")
