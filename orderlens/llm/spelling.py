"""Spelling variants grouped by range searches in K-d trees over letter counts.

1. The words of all texts are counted by built-in expressions; copies are combined before the shuffle. Words of at least
   ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences are the vocabulary, a written table.
2. A word is a point whose coordinates are its letter counts (``DIMS``; rarer letters share some). One edit adds one to
   a coordinate, takes one from another, or both: the L1 distance is at most two, and one between lengths that differ.
3. Points are dealt to cells by length and, where a length has more than ``CELL`` words, by the leaves of a K-d tree
   grown on a bounded sample. Every word searches its own length and the next: it goes to each cell whose box one edit
   can reach, so every pair meets in exactly one cell, that of the searched word.
4. In a cell a K-d tree over the different letter counts is searched by all its queries at once, pruned by the boxes of
   the nodes. The pairs of words that are left are held letter by letter against each other. Only a count and the best
   partner per word and cell leave the task, never pairs.
5. A word's form is its most frequent near word, if that is frequent enough; roots follow from doubling the links.

A cell of more than ``2 * CELL`` points (many words of the same letters) is split by hash and its queries go to all
parts, so no group grows with the vocabulary. Nothing is capped.

Defined results: null and empty texts have no words; a null id counts as an empty text in the hash; repeated rows count
again; ties go to the smallest word in code-point order; an empty table gives an empty result; other columns and the
order of rows don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import ascii_lower, written

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, FACTOR, DROPPED = 7, 2, 10, 31
DIMS = 32  # a to z; other letters by their code point modulo 6
CELL = 50_000  # words of a length that one cell is meant to hold
SAMPLE = 100_000  # words that the trees over cells are grown on, at most
LEAF = 32  # different letter counts in a leaf of a cell's tree
PAIRS = 1_000_000  # pairs of words compared at once
OPEN = 1 << 30


# -- words

def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of the contract with their counts."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    # a run shorter than a word can't become one
    runs = F.regexp_extract_all(text, F.lit(f"{RUN}{{{MIN_LENGTH},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "_id", "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    rows = rows.select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run")).alias("word"))
    rows = rows.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") >= MIN_COUNT)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words joined, lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of ``DIMS`` counts per word."""
    codes, lengths = letters_of(words)
    place = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 6).astype(np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * DIMS + place, minlength=len(words) * DIMS).reshape(-1, DIMS)
    return counts.astype(np.int8 if lengths.max(initial=0) < 100 else np.int32)


def reachable(points: np.ndarray, low: np.ndarray, high: np.ndarray, longer: bool) -> np.ndarray:
    """Which points have a place inside the box one edit away: at most one letter more and, in the same length, one fewer."""
    fits = np.maximum(low - points, 0).sum(axis=1) <= 1
    near = np.nonzero(fits)[0]
    fits[near] = np.maximum(points[near] - high, 0).sum(axis=1) <= (0 if longer else 1)
    return fits


# -- trees

@dataclass
class Node:
    """A box around points; a leaf holds their places, another node its two parts."""
    low: np.ndarray
    high: np.ndarray
    places: np.ndarray
    parts: tuple[Node, Node] | None = None


def split_at(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, largest count that goes left) at the median of the widest dimension; None if all points are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    if (low == high).all():
        return None
    dim = int(np.where(low < high, points.var(axis=0), -1.0).argmax())
    middle = int(np.median(points[:, dim]))
    return dim, min(middle, int(high[dim]) - 1)


def tree_of(points: np.ndarray, places: np.ndarray, leaf: int = LEAF) -> Node:
    mine = points[places]
    node = Node(mine.min(axis=0), mine.max(axis=0), places)
    cut = split_at(mine) if len(places) > leaf else None
    if cut:
        left = mine[:, cut[0]] <= cut[1]
        node.parts = tree_of(points, places[left], leaf), tree_of(points, places[~left], leaf)
    return node


def near_vectors(points: np.ndarray, queries: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) places whose letter counts one edit can turn into each other, by one search for all queries."""
    found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(tree_of(points, np.arange(len(points))), np.arange(len(queries)))] if len(points) else []
    while stack:
        node, asked = stack.pop()
        asked = asked[reachable(queries[asked], node.low, node.high, longer)]
        if not len(asked):
            continue
        if node.parts:
            stack += [(node.parts[0], asked), (node.parts[1], asked)]
            continue
        for k in range(0, len(asked), 4096):
            some = asked[k:k + 4096]
            for place in node.places:  # a leaf has few different counts
                ok = some[reachable(queries[some], points[place], points[place], longer)]
                found_q.append(ok)
                found_p.append(np.full(len(ok), place))
    return np.concatenate(found_q), np.concatenate(found_p)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters ``a`` become those of ``b`` by one edit; ``b`` may be one letter longer."""
    if a.dtype == np.uint64:  # eight letters a number: fold every differing byte to its lowest bit and add the bits
        differ = np.zeros(len(a), np.uint64)
        for x, y in zip(a.T, b.T, strict=True):
            d = x ^ y
            for bits, inside in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
                d = d | (d >> np.uint64(bits) & np.uint64(inside))
            differ += (d & np.uint64(0x0101010101010101)) * np.uint64(0x0101010101010101) >> np.uint64(56)
        return differ == 1
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def letter_rows(words: list[str], packed: bool) -> np.ndarray:
    """Words of one length as rows of letters; all letters are below 256. ``packed``: eight of them a number."""
    rows = letters_of(words)[0].astype(np.uint8).reshape(len(words), -1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64) if packed else rows


def near_words(points: list[str], queries: list[str], longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (query, point) places of near words; the points have one length, the queries the same or one less."""
    if not points or not queries:
        return
    kinds_p, of_p = np.unique(letter_counts(points), axis=0, return_inverse=True)
    kinds_q, of_q = np.unique(letter_counts(queries), axis=0, return_inverse=True)
    by_p, by_q = np.argsort(of_p, kind="stable"), np.argsort(of_q, kind="stable")
    start_p = np.concatenate([[0], np.cumsum(np.bincount(of_p))])
    start_q = np.concatenate([[0], np.cumsum(np.bincount(of_q))])
    letters_p, letters_q = letter_rows(points, not longer), letter_rows(queries, not longer)
    q, p = near_vectors(kinds_p, kinds_q, longer)
    wide = start_p[p + 1] - start_p[p]
    # a row per query word and kind of point, then its words, in batches of bounded size
    reps = start_q[q + 1] - start_q[q]
    pair = np.repeat(np.arange(len(q)), reps)
    word = by_q[np.repeat(start_q[q] - (np.cumsum(reps) - reps), reps) + np.arange(len(pair))]
    size = wide[pair]
    ends = np.cumsum(size)
    at = 0
    while at < len(pair):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        reps = size[at:end]
        a = np.repeat(word[at:end], reps)
        b = by_p[np.repeat(start_p[p[pair[at:end]]] - (np.cumsum(reps) - reps), reps) + np.arange(len(a))]
        near = one_edit(letters_q[a], letters_p[b])
        yield a[near], b[near]
        at = end


# -- cells

def cells_of(words: DataFrame) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Per length of more than ``CELL`` words the boxes that share its points, as (low, high), both inclusive.

    They come from a sample of at most ``SAMPLE`` words, whatever the size of the vocabulary.
    """
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word").alias("length")).count().filter(F.col("count") > CELL).collect()}
    if not sizes:
        return {}
    many = words.filter(F.length("word").isin(list(sizes)))
    sample = [r[0] for r in many.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    out = {}
    for length, size in sizes.items():
        mine = [w for w in sample if len(w) == length]
        boxes, stack = [], []
        if mine:
            leaf = max(8, len(mine) * CELL // size)
            stack = [(letter_counts(mine), np.zeros(DIMS, np.int64), np.full(DIMS, OPEN))]
        while stack:
            points, low, high = stack.pop()
            cut = split_at(points) if len(points) > leaf else None
            if not cut:
                boxes.append((low, high))
                continue
            dim, top = cut
            left = points[:, dim] <= top
            below, above = high.copy(), low.copy()
            below[dim], above[dim] = top, top + 1
            stack += [(points[left], low, below), (points[~left], above, high)]
        out[length] = boxes or [(np.zeros(DIMS, np.int64), np.full(DIMS, OPEN))]
    return out


def dealt(words: DataFrame, boxes: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(length, cell, searched, word, n): every word once as a searched one, and as a query in each cell that it can reach."""
    whole = [(np.zeros(DIMS, np.int64), np.full(DIMS, OPEN))]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, n = batch["word"].to_numpy(object), batch["n"].to_numpy(np.int64)
            counts, lengths = letter_counts(text.tolist()), batch["word"].str.len().to_numpy(np.int64)
            for length in np.unique(lengths):
                mine = np.nonzero(lengths == length)[0]
                for target in (int(length), int(length) + 1):
                    for cell, (low, high) in enumerate(boxes.get(target, whole)):
                        asked = mine[reachable(counts[mine], low, high, target > length)]
                        kinds = [(False, asked)]
                        if target == length:
                            inside = (counts[mine] >= low).all(axis=1) & (counts[mine] <= high).all(axis=1)
                            kinds.append((True, mine[inside]))
                        for searched, rows in kinds:
                            if len(rows):
                                yield pd.DataFrame({"length": target, "cell": cell, "searched": searched, "word": text[rows],
                                                    "n": n[rows]})

    return words.mapInPandas(deal, "length int, cell int, searched boolean, word string, n long")


def best_of(part: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) per word of a cell with near words: their count and the best of them."""
    points, queries = part[part["searched"]], part[~part["searched"]]
    words, counts = points["word"].tolist(), points["n"].to_numpy(np.int64)
    found: tuple[list, ...] = ([], [], [], [])
    for longer in (False, True):
        asking = queries[(queries["word"].str.len() < part["length"].iloc[0]) == longer] if len(queries) else queries
        asked, asked_n = asking["word"].tolist(), asking["n"].to_numpy(np.int64)
        ways = [(asked, words, counts)] + ([(words, asked, asked_n)] if longer else [])  # between lengths only one searches
        sums = [(np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.full(len(w), -1)) for w, _, _ in ways]
        orders = [np.argsort(np.argsort(np.array(of, dtype=object))) if of else np.zeros(0, np.int64) for _, of, _ in ways]
        for a, b in near_words(words, asked, longer):
            for k, (x, y) in enumerate(((a, b), (b, a))[:len(ways)]):
                total, best_n, best = sums[k]
                np.add.at(total, x, 1)
                by = np.lexsort((orders[k][y], -ways[k][2][y], x))
                x, y = x[by], y[by]
                first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
                x, y = x[first], y[first]
                n = ways[k][2][y]
                better = (n > best_n[x]) | ((n == best_n[x]) & (orders[k][y] < orders[k][best[x]]))
                best_n[x[better]], best[x[better]] = n[better], y[better]
        for (w, of, _), (total, best_n, best) in zip(ways, sums, strict=True):
            has = np.nonzero(total)[0]
            for out, more in zip(found, ([w[i] for i in has], total[has].tolist(), best_n[has].tolist(),
                                         [of[i] for i in best[has]]), strict=True):
                out += more
    kinds = {"word": object, "n_near": np.int64, "form_n": np.int64, "form": object}
    return pd.DataFrame({c: pd.Series(x, dtype=kind) for (c, kind), x in zip(kinds.items(), found, strict=True)})


def partners(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): words that have near words, with their number and the most frequent (ties: smallest)."""
    rows = written(dealt(words, cells_of(words)), "spelling-cells")
    sizes = rows.filter("searched").groupBy("length", "cell").count().filter(F.col("count") > 2 * CELL)
    parts = written(sizes.select("length", "cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "spelling-crowded")
    rows = rows.join(F.broadcast(parts), ["length", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("searched"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    best = rows.groupBy("length", "cell", "part").applyInPandas(best_of, "word string, n_near long, form_n long, form string")
    least = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("b")
    return best.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select(
        "word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def variants(docs: DataFrame, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of the vocabulary."""
    words = written(vocabulary(docs, id_col, text_col), "spelling-words")
    near = words.join(partners(words), "word", "left")
    enough: Column = F.col("form_n") >= factor * F.col("n")
    rows = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")),
                   "spelling-forms")
    top = rows.agg(F.max("n")).first()[0] or 1
    # each link multiplies the count, so chains have few links; every round doubles what a root has followed
    links = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    longest = int(math.log(max(1.0, top / MIN_COUNT), factor)) + 1
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        links = written(links, "spelling-links")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
