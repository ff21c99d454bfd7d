"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A document's set is its distinct 5-word shingles (its whole word sequence if it
has fewer words). Documents are linked if 100 * |A & B| >= 75 * |A | B|.

1. Texts with equal words are one class, known by a 64-bit hash; only classes
   go on, so any number of exact copies costs one signature.
2. Signatures of 128 minima make 32 bands of 4: a pair at similarity 0.75
   shares no band with probability (1 - 0.75 ** 4) ** 32, about 5e-6.
3. Round one compares every member of a bucket with the bucket's centre (its
   smallest class): a row per member, however large the bucket. Round two
   compares what round one left open: members of one bucket that are in
   different components by then. Large buckets are cut into blocks, and the
   pairs of blocks are compared inside tasks, first by signatures alone, which
   name the members that any comparison leaves open, then with the sets of
   those, in blocks by bytes, verified in place and joined where linked: a
   block returns no more rows than it has members, and pairs are never rows.
   Members meet their signatures and sets before they are dealt to blocks, and
   blocks number with the root of a bucket's members (more only where their
   sets need the room), so a bucket of n makes n rows up to 4 * ``BLOCK`` and
   n ** 1.5 / ``BLOCK`` ** 0.5 at most beyond.
   A pair is verified in its first common band only.
4. A comparison reads signatures in batches of 16 and stops when the posterior
   probability of similarity >= 0.75 (uniform prior) is below ``MISS``.
5. Survivors are verified on their full sets, as 64-bit shingle hashes.
6. Verified links make components by repeated smallest-label steps on tables.

No bucket is capped and no pair dropped but by 2 and 4.

Defined results: texts without words have empty sets and no links; equal rows
are linked as copies are; rows with one id are judged by their texts; rows with
a null id keep a null component unless linked to a document with an id, and a
component without any id keeps all its rows; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import written

SHINGLE, SIMILAR = 5, 75  # words; percent
BANDS, ROWS, BATCH = 32, 4, 16
HASHES = BANDS * ROWS
MISS = 1e-6  # chance, at each batch, that a pruned pair is similar after all
BLOCK = 1000  # a bucket of n members is cut into the root of n / BLOCK blocks
BLOCK_BYTES = 32 << 20  # of these members' sets, one longer set aside
MAX_BROADCAST = 2_000_000  # class ids (8 bytes each)

_rng = np.random.default_rng(20240501)
MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
POWERS = [np.uint64(p) for p in _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * 2 + 1]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space; bytes.lower() changes A-Z alone."""
    return text.encode().lower().split() if text else []


def class_of(words: list[bytes]) -> int | None:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(POWERS):
        total += h[k:k + n] * p
    return np.unique(mixed(total))


def signature(sh: np.ndarray) -> np.ndarray:
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (MULTIPLY * x[None, i:i + 4096] + ADD).min(axis=1), out=out)
    return out


def least_matches() -> list[int]:
    """For 16, 32, ... compared minima: the fewest matches that aren't pruned.

    With a uniform prior the posterior P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m).
    """
    t, out = SIMILAR / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, m = 0.0, -1
        while p < MISS:
            m += 1
            p += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


LEAST = least_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs (a[i], b[i]) of signatures that no batch prunes."""
    at, found = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(LEAST):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        found = found + (a[at, cols] == b[at, cols]).sum(axis=1, dtype=np.int32)
        on = found >= least
        at, found = at[on], found[on]
    return at


def signatures_of(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of binary signatures as a matrix."""
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.uint32).reshape(-1, HASHES)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, node, n_shingles, sig) per row: its text's hash, class, set size and signature (null for an empty set)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sigs = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                sh = shingles(words)
                sizes.append(len(sh))
                nodes.append(class_of(words))
                sigs.append(signature(sh).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sigs, pa.binary())], ["_id", "_hash", "node", "n_shingles", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col))
    return texts.mapInArrow(rows, f"_id {kind}, _hash long, node long, n_shingles long, sig binary")


def bands_of(classes: DataFrame) -> DataFrame:
    """(bucket, band, node): 32 rows per class."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array([int(p) for p in POWERS[:ROWS]], np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = signatures_of(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            band = np.arange(BANDS, dtype=np.uint64)
            key = mixed((sig * weights).sum(axis=2, dtype=np.uint64) + band * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(band.astype(np.int32), len(sig))),
                 pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "band", "node"])

    return classes.select("node", "sig").mapInArrow(rows, "bucket long, band int, node long")


def pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures aren't pruned."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = survivors(signatures_of(batch.column(2)), signatures_of(batch.column(3)))
                yield batch.select(["a", "b"]).take(pa.array(at))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(rows, "a long, b long")


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set): the sorted shingle hashes of some classes; only texts that these name are taken apart."""
    wanted = written(nodes.distinct().join(classes.select("node", "first"), "node"), "near-wanted")
    n, without_id = wanted.agg(F.count("*"), F.sum(F.col("first").isNull().cast("long"))).first()
    ids = wanted.select(F.col("first").alias("_first")).filter("_first is not null").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    named = texts.join(F.broadcast(ids) if n <= MAX_BROADCAST else ids, F.col("_id") == F.col("_first"), "left_semi")
    if without_id:
        named = named.unionByName(texts.filter("_id is null"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(w) for w in words], pa.int64()),
                 pa.array([shingles(w).tobytes() for w in words], pa.binary())], ["node", "set"])

    full = named.select("_text").mapInArrow(sets, "node long, set binary").join(wanted.select("node"), "node", "left_semi")
    return written(full.groupBy("node").agg(F.first("set").alias("set")), "near-sets")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two whole sets are similar enough."""
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= SIMILAR * (x.size + y.size - common)


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                  for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    side = lambda c: full.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
    return written(both.mapInArrow(rows, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): every linked node with the smallest node that it reaches.

    A step takes the smallest label of a node and its neighbours, then that label's own label; every step is written.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = written(both, "near-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = written(least, "near-least")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = least.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("old")).alias("moved"))
        labels = written(step, "near-labels")
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "label")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, node, label, n): members, but for the centre, of buckets in which several components meet."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    state = known.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed_up = state.filter((F.col("n") >= 3) & (F.col("low") != F.col("high"))).select("bucket", "n")
    rest = known.filter(F.col("node") != F.col("centre")).join(mixed_up, "bucket")
    return written(rest.select("bucket", "band", "node", "label", "n"), "near-open")


def block_count(n: Column) -> Column:
    """Blocks of a bucket of ``n`` members: copies of a member grow with the root of n, and so do the blocks."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(n / BLOCK)))


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Every member (bucket, band, node, label, …) beside each pair of blocks (i, j) of its bucket that holds its own."""
    rest = [c for c in members.columns if c not in ("bucket", "band", "node", "label")]
    own = F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    # a block meets itself and all others
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other")
    return members.select("bucket", "band", "node", "label", *rest, own, other).select(
        "bucket", "band", "node", "label", *rest, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def compared(part: pd.DataFrame, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per member of block i the members of block j, nearest first, that have another label, survive, and share no earlier
    band; ``label`` may change meanwhile."""
    i, j, band = int(part["i"].iloc[0]), int(part["j"].iloc[0]), int(part["band"].iloc[0])
    sig, nodes, own = signatures_of(part["sig"]), part["node"].to_numpy(), part["own"].to_numpy()
    later = np.nonzero(own == j)[0]
    for x in np.nonzero(own == i)[0]:
        apart = later[(label[later] != label[x]) & ((nodes[later] > nodes[x]) if i == j else True)]
        apart = apart[survivors(np.broadcast_to(sig[x], (len(apart), HASHES)), sig[apart])]
        same = sig[apart] == sig[x]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        yield x, apart[first][np.argsort(-same[first].sum(axis=1), kind="stable")]


def surviving(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, band, node, label, n_shingles): the members that survive a comparison with another component's;
    signatures alone."""
    def named(part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(len(part), bool)
        for x, ys in compared(part, part["label"].to_numpy()):
            on[x] |= len(ys) > 0
            on[ys] = True
        return part.loc[on, ["bucket", "band", "node", "label", "n_shingles"]]

    dealt = in_blocks(known.join(classes.select("node", "sig", "n_shingles"), "node"), block_count(F.col("n"))).drop("n")
    found = dealt.groupBy("bucket", "i", "j").applyInPandas(
        named, "bucket long, band int, node long, label long, n_shingles long")
    return written(found.distinct(), "near-surviving")


def open_links(known: DataFrame, classes: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) that join components inside buckets, of the surviving members: each two that nothing joins yet are
    compared in their pair of blocks and, if they survive, verified in place, so that a block returns fewer links than it
    has members."""
    blocks = known.groupBy("bucket").agg(
        F.greatest(block_count(F.count("*")), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("blocks"))
    own = full.join(classes.select("node", "sig"), "node")  # a row per class, not per member
    dealt = in_blocks(known.drop("n_shingles").join(blocks, "bucket").join(own, "node"), F.col("blocks")).drop("blocks")

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        nodes, sets, label = part["node"].to_numpy(), part["set"].to_list(), part["label"].to_numpy().copy()
        out = []
        for x, ys in compared(part, label):
            for y in ys:
                if label[x] != label[y] and similar(*(np.frombuffer(sets[k], np.uint64) for k in (x, y))):
                    out.append((nodes[x], nodes[y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("bucket", "i", "j").applyInPandas(joined, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, node, n_shingles, component_id) per row of ``docs``: id, text hash, class, set size, and the smallest
    id that its links reach."""
    told = written(described(docs, id_col, text_col), "near-told")
    # a class's smallest id, and its signature and set size, which are the same in all its rows
    classes = written(told.filter("sig is not null").groupBy("node")
                      .agg(F.min("_id").alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")),
                      "near-classes")
    bands = written(bands_of(classes), "near-bands")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = written(bands.join(buckets, "bucket"), "near-members")
    star = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = written(pruned(star, classes), "near-star")
    both = star.select(F.col("a").alias("node")).union(star.select("b"))
    links = verified(star, sets_of(both, classes, docs, id_col, text_col))
    known = surviving(open_members(members, components(links)), classes)
    full = sets_of(known.select("node"), classes, docs, id_col, text_col)
    links = links.unionByName(written(open_links(known, classes, full), "near-more"))
    found = (classes.select("node", "first").join(components(links), "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    smallest = found.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = found.join(smallest, "label").select("node", "component_id")
    return told.drop("sig").join(by_class, "node", "left").select(
        "_id", "_hash", "node", "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))


def component_rows(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return near_duplicates(docs).select(
        F.col("_id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id isn't their component's; columns and other rows unchanged.

    Rows without an id go if their component has one; rows that repeat the kept id and text stay.
    """
    found = near_duplicates(docs)
    gone = written(found.filter(F.coalesce(F.col("_id") != F.col("component_id"), F.col("component_id").isNotNull()))
                   .select("_id", "_hash").distinct(), "near-gone")
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")


#: The same components in DuckDB's SQL: all pairs that share a shingle, then reachability.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM starts),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.r JOIN n y ON p.b = y.r WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.q = e.a),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.q = d.r GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id,
  coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM d JOIN c ON d.r = c.r LEFT JOIN n ON d.r = n.r
"""
