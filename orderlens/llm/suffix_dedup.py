"""Removal of repeated byte strings by suffix arrays built with a difference cover.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller id goes. Whole equal cuts (below) are matched by two 64-bit
hashes, the key and the cut's own, without comparing their bytes: two of a key's
c different cuts are taken for one with a chance of at most c^2 / 2^65. Strings
that different cuts of one key share are sorted, not hashed: shards of text build
suffix arrays by the difference-cover method modulo 3 (sort the triples at two
of three positions, recurse on their names, merge the rest) and equal strings
are found by comparing adjacent suffixes. A key with a single cut needs no sort.

Text reaches shards so that equal strings always meet, without a row a byte:
1. A string's key is the least hash of its ``GRAM``-byte parts, so equal strings
   have equal keys, and strings at following places mostly share one: a run of
   places with one key is one row. Runs whose key is in one document only can't
   repeat; a count by key leaves them out.
2. A run's bytes, its cut, go by their hash until they are needed. Equal cuts
   meet with their smallest document: every later document loses all of that cut.
3. Of keys with several different cuts, each cut's bytes are fetched once, from
   its smallest document, into the key's shard. The shard's suffix array names
   the strings; a cut's first document loses the strings that another cut has in
   a smaller document. Before that, cuts shrink to the strings between those whose
   first and last eight bytes another document's cut in the shard has too; the
   others can't repeat.
4. Every document unites its lost places and drops their bytes.

Keys that occur in two documents of one batch are known to repeat there and
then: their runs pass through, spread over the shards, and one mark per batch
goes to the key's shard. A key with more than ``MANY`` different cuts would
overload its shard; its strings are compared as rows of 128-bit hashes instead.
So no group grows with the number of documents.

Defined results: null and empty texts have no bytes; documents with one id are
one document, which loses nothing to itself; a null id counts as the largest
long; rows with equal id and text are sorted once and get equal results; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import written

LENGTH, GRAM = 50, 16
PLACES = 64  # of a run at most: its lost places are the bits of one number
SHARD = 1_000_000  # runs, in finding keys; bytes of cuts, in sorting suffixes
DOCUMENTS = 1000  # whose runs are dealt at once
AT_ONCE = 1 << 16  # bytes of texts whose runs are found at once; a text beyond it comes whole
CUT = 1 << 20  # bytes of cuts that go on at once
MANY = 20_000  # cuts of one key that a shard takes
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_at(text: bytes) -> np.ndarray:
    """The eight bytes from every place of a text as one number."""
    return np.ndarray(max(len(text) - 7, 0), "<u8", text, strides=(1,)).copy()


def keys_of(eight: np.ndarray) -> np.ndarray:
    """The key of the string at every place of a text of at least ``LENGTH`` bytes, from its ``words_at``."""
    least = mixed(eight[:8 - GRAM] * P1 + eight[GRAM - 8:] * P2)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:len(least) - (width - span)], least[width - span:])


def runs_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, cut_hash, start, places) of the runs of texts: following places of one text with one key, at most ``PLACES``."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    whole = b"".join(texts)
    if not len(sizes) or sizes.max() < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none
    eight = words_at(whole)
    keys = keys_of(eight)
    new = np.empty(len(keys) + 1, bool)  # where a key, a text, or the places that cross a text's end begin
    new[0] = new[-1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
    crossing = np.maximum(begin + sizes - LENGTH + 1, begin)
    new[np.minimum(begin, len(keys))] = new[np.minimum(crossing, len(keys))] = True
    first = np.nonzero(new)[0]
    size = np.diff(first)
    first = first[:-1]
    owner = np.searchsorted(begin, first, "right") - 1
    inside = first < crossing[owner]
    first, size, owner = first[inside], size[inside], owner[inside]
    if size.max() > PLACES:  # periodic text
        parts = -(-size // PLACES)
        before = np.repeat(first, parts)
        nth = np.arange(len(before)) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(first + size, parts)
        owner = np.repeat(owner, parts)
        first = before + nth * PLACES
        size = np.minimum(end - first, PLACES)
    return owner, keys[first], hashes_of(eight, first, size + LENGTH - 1), first - begin[owner], size


def runs_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, places) of the runs of one text."""
    _, key, _, start, places = runs_in([text])
    return key, start, places


def hashes_of(eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every cut (at least ``LENGTH``): a sum of mixed words of eight bytes, each with its place."""
    total = mixed(eight[start + size - 8] + size.astype(np.uint64) * P1)
    for k in range(int(size.max(initial=0)) // 8):
        some = slice(None) if 8 * k + 8 <= LENGTH else np.nonzero(size >= 8 * k + 8)[0]
        total[some] += mixed(eight[start[some] + 8 * k] * P2 + mixed(np.array([k + 1], np.uint64) * P1))
    return mixed(total).view(np.int64)


# -- suffix arrays

def suffix_places(s: np.ndarray, depth: int = 0) -> np.ndarray:
    """For every suffix of the whole numbers ``s`` (all above 0) how many are smaller, by the difference cover modulo 3.

    Names of names cover 3 ** (depth + 1) numbers; once that is ``LENGTH``, equal names need no telling apart: suffixes
    of one place are equal in their first ``LENGTH`` numbers, and the order is right by these.
    """
    n = len(s)
    if n < 6:
        tails = [tuple(s[i:]) for i in range(n)]
        return np.array([sum(x < y for x in tails) for y in tails], np.int64)
    padded = np.concatenate([s, np.zeros(5, s.dtype)]).astype(np.int32)
    top = n + (n % 3 == 1)  # an empty suffix ends the places 1 mod 3 if they reach the end
    sample = np.concatenate([np.arange(1, top, 3), np.arange(2, top, 3)])
    names = named(padded[sample], padded[sample + 1], padded[sample + 2])
    if names.max() + 1 < len(sample) and 3 ** (depth + 1) < LENGTH:
        names = suffix_places(names + 1, depth + 1)
    rank = np.zeros(n + 5, np.int32)
    rank[sample] = names + 1
    # the remaining suffixes follow their first number and the sampled suffix after it; merge by counting on both sides
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    by_one = np.concatenate([zero, one])
    by_two = np.concatenate([zero, two])
    low = named(padded[by_one], rank[by_one + 1], np.zeros(1, np.int32))
    high = named(padded[by_two], padded[by_two + 1], rank[by_two + 2])
    z = len(zero)
    among_sample = smaller(np.concatenate([rank[one], rank[two]]), n + 2)
    zeros_low, zeros_high = smaller(low[:z], len(by_one)), smaller(high[:z], len(by_two))
    place = np.empty(n, np.int32)  # how many suffixes are smaller: equal ones share a place
    place[zero] = zeros_low[low[:z]] + smaller(low[z:], len(by_one))[low[:z]] + smaller(high[z:], len(by_two))[high[:z]]
    place[one] = among_sample[rank[one]] + zeros_low[low[z:]]
    place[two] = among_sample[rank[two]] + zeros_high[high[z:]]
    return place


def smaller(values: np.ndarray, top: int) -> np.ndarray:
    """At every number up to ``top``, how many of ``values`` are smaller."""
    counts = np.bincount(values, minlength=top + 1).astype(np.int32)
    return np.cumsum(counts, dtype=np.int32) - counts


def named(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Ranks of triples, equal ones alike, by one sort."""
    wide_b, wide_c = int(b.max(initial=0)) + 1, int(c.max(initial=0)) + 1
    triples = (int(a.max(initial=0)) + 1) * wide_b * wide_c
    if triples < 1 << 62:
        triple = (a.astype(np.int64) * wide_b + b) * wide_c + c
        if triples <= 4 * len(a):  # so few that they are counted, not sorted
            there = np.zeros(triples, bool)
            there[triple] = True
            return (np.cumsum(there, dtype=np.int32) - 1)[triple]
        order = np.argsort(triple)
        new = np.diff(triple[order]) != 0
    else:
        c = np.broadcast_to(c, a.shape)
        order = np.lexsort((c, b, a))
        new = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    out = np.empty(len(a), np.int32)
    out[order[:1]] = 0
    out[order[1:]] = np.cumsum(new, dtype=np.int32)
    return out


def narrowed(cuts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cut, low, high): the cuts with strings whose first and last eight bytes a cut of another ``first`` document has too,
    with the places of the first and the last of these strings. All strings of two documents are among them."""
    sizes = np.array([len(c) for c in cuts])
    places = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(cuts)), places)
    if not len(owner):
        return owner, owner, owner
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
    eight = words_at(b"".join(cuts))
    at = (np.cumsum(sizes) - sizes)[owner] + inside
    ends = eight[at] * P1 + eight[at + LENGTH - 8] * P2
    order = np.argsort(ends)
    start = np.concatenate([[0], np.nonzero(np.diff(ends[order]))[0] + 1])
    documents = first[owner[order]]
    several = np.minimum.reduceat(documents, start) != np.maximum.reduceat(documents, start)
    there = np.zeros(len(owner), bool)
    there[order[np.repeat(several, np.diff(np.append(start, len(order))))]] = True
    there = np.nonzero(there)[0]
    cut, low = np.unique(owner[there], return_index=True)
    return cut, inside[there[low]], inside[there[np.append(low[1:], len(there)) - 1]] if len(there) else low


def lost_places(cuts: list[bytes], first: np.ndarray) -> np.ndarray:
    """Per cut the bits of the places whose string another cut holds with a smaller ``first`` document."""
    bits = np.zeros(len(cuts), np.uint64)
    cut, low, high = narrowed(cuts, first)
    if not len(cut):
        return bits
    cuts = [cuts[c][i:j + LENGTH] for c, i, j in zip(cut.tolist(), low.tolist(), high.tolist(), strict=True)]
    ended = b"\0".join(cuts) + b"\0"
    text = np.frombuffer(ended, np.uint8)
    sizes = np.array([len(c) for c in cuts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # ends of cuts are 1 and the bytes that occur 2, 3, ..., so a string of LENGTH bytes never matches across an end
    ends = begin + sizes
    there = np.bincount(text, minlength=256) > 0
    text = (np.cumsum(there, dtype=np.int32) + 1)[text]
    text[ends] = 1
    place = suffix_places(text)
    owner = np.repeat(np.arange(len(cuts)), sizes + 1)
    inside = np.arange(len(text)) - begin[owner]
    whole = inside + LENGTH <= sizes[owner]
    order = np.nonzero(whole)[0]
    order = order[np.argsort(place[order])]
    eight = words_at(ended)
    same = np.ones(len(order) - 1, bool)  # as the suffix before it, in its first LENGTH bytes
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= eight[order[:-1] + k] == eight[order[1:] + k]
    start = np.concatenate([[0], np.nonzero(~same)[0] + 1])
    documents = first[cut[owner[order]]]
    least = np.repeat(np.minimum.reduceat(documents, start), np.diff(np.append(start, len(order))))
    lost = order[documents > least]
    bit = np.uint64(1) << (inside[lost] + low[owner[lost]]).astype(np.uint64)
    np.bitwise_or.at(bits, cut[owner[lost]], bit)
    return bits


# -- the steps on tables

def document_key(id_col: str, text_col: str) -> list[Column]:
    """_order, a document's place among the ids, and _hash, that of its text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_order"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_order, _hash, _text) of every row."""
    return docs.select(*document_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def once(columns: list[np.ndarray]) -> np.ndarray:
    """The places of the rows that are the first of their kind."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c[by]) != 0
    return np.sort(by[new])


def repeating_runs(docs: DataFrame, shards: int) -> DataFrame:
    """(_order, _hash, key, cut_hash, start, places): the runs whose key is in two documents, or is the same in one batch
    of them, with the hash of their bytes; rows of equal id and text tell theirs once."""
    fields = ["_order", "_hash", "key", "cut_hash", "start", "places", "state"]
    packed = "shard int, " + ", ".join(f"{f} binary" for f in fields)
    types = [np.int64, np.int64, np.uint64, np.int64, np.int32, np.int8, np.int8]
    alone, passing, mark = 0, 1, 2

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, DOCUMENTS) for b in batches for k in range(0, b.num_rows, DOCUMENTS)):
            kept = once([batch.column(c).to_numpy() for c in (0, 1)])
            own = [batch.column(c).to_numpy()[kept] for c in (0, 1)]
            texts = batch.column(2).take(pa.array(kept)).cast(pa.binary())
            part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // AT_ONCE
            ends = np.append(np.nonzero(np.diff(part))[0] + 1, len(texts)).tolist()
            told = [runs_in(texts[i:j].to_pylist()) for i, j in zip([0, *ends], ends, strict=False)]
            doc = np.concatenate([t[0] + i for t, i in zip(told, [0, *ends], strict=False)])
            key, cut_hash, start, places = (np.concatenate([t[c] for t in told]) for c in (1, 2, 3, 4))
            if not len(key):
                continue
            order = own[0][doc]
            by = np.argsort(key)
            first = np.concatenate([[0], np.nonzero(np.diff(key[by]))[0] + 1])
            again = np.minimum.reduceat(order[by], first) != np.maximum.reduceat(order[by], first)
            state = np.empty(len(key), np.int8)
            state[by] = np.repeat(np.where(again, passing, alone), np.diff(np.append(first, len(key))))
            marks = by[first[again]]
            rows = [np.concatenate([c, c[marks]]) for c in (order, own[1][doc], key, cut_hash, start, places)]
            state = np.concatenate([state, np.full(len(marks), mark, np.int8)])
            spread = np.where(state == passing, mixed(rows[1].view(np.uint64) + rows[4].astype(np.uint64)), rows[2])
            shard = (spread % np.uint64(shards)).astype(np.int32)
            by = np.argsort(shard, kind="stable")
            cuts = np.concatenate([[0], np.nonzero(np.diff(shard[by]))[0] + 1])
            columns = [np.asarray(c[by], t) for c, t in zip((*rows, state), types, strict=True)]
            ends = np.append(cuts[1:], len(by))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[by][cuts]), *(pa.array([c[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())
                                              for c in columns)], ["shard", *fields])

    def met(part: pd.DataFrame) -> pd.DataFrame:
        order, hashes, key, cut_hash, start, places, state = (
            np.frombuffer(b"".join(part[f]), t) for f, t in zip(fields, types, strict=True))
        by = np.nonzero(state != passing)[0]
        by = by[np.argsort(key[by])]
        keep = state == passing
        if len(by):
            first = np.concatenate([[0], np.nonzero(np.diff(key[by]))[0] + 1])
            many = (np.minimum.reduceat(order[by], first) != np.maximum.reduceat(order[by], first)) | np.maximum.reduceat(state[by] == mark, first)
            keep[by] = np.repeat(many, np.diff(np.append(first, len(by)))) & (state[by] == alone)
        keep = np.nonzero(keep)[0]
        keep = keep[once([c[keep] for c in (order, hashes, start)])]
        return pd.DataFrame({"_order": order[keep], "_hash": hashes[keep], "key": key[keep].view(np.int64),
                             "cut_hash": cut_hash[keep], "start": start[keep], "places": places[keep].astype(np.int32)})

    return docs.mapInArrow(dealt, packed).groupBy("shard").applyInPandas(
        met, "_order long, _hash long, key long, cut_hash long, start int, places int")


def with_bytes(cuts: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, cut_hash, first, cut): the bytes of ``cuts`` from the texts of the documents that they name."""
    wanted = cuts.groupBy("_order", "_hash").agg(F.collect_list(F.struct("key", "cut_hash", "start", "places")).alias("cuts"))
    texts = docs.groupBy("_order", "_hash").agg(F.first("_text").alias("_text"))  # rows of equal id and text are read once

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["key", "cut_hash", "first", "cut"]
        for batch in batches:
            keys, hashes, first, found, held = [], [], [], [], 0
            for k in range(batch.num_rows):
                text, cuts = batch.column(1)[k].as_py().encode(), batch.column(2)[k].values
                start, places = cuts.field("start").to_pylist(), cuts.field("places").to_pylist()
                keys.append(cuts.field("key"))
                hashes.append(cuts.field("cut_hash"))
                first += [batch.column(0)[k].as_py()] * len(start)
                found += [text[i:i + n + LENGTH - 1] for i, n in zip(start, places, strict=True)]
                held += sum(places) + len(start) * (LENGTH - 1)
                if held >= CUT or k == batch.num_rows - 1:  # a document's cuts are a few times its text
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(keys), pa.concat_arrays(hashes), pa.array(first, pa.int64()),
                         pa.array(found, pa.binary())], fields)
                    keys, hashes, first, found, held = [], [], [], [], 0

    return texts.join(wanted, ["_order", "_hash"]).select("_order", "_text", "cuts").mapInArrow(
        cut, "key long, cut_hash long, first long, cut binary")


def judged(runs: DataFrame, docs: DataFrame, shuffles: int) -> DataFrame:
    """(key, cut_hash, first, bits): cuts with their smallest document and that document's lost places: a row for a cut
    that other documents hold, and one for a cut whose smallest document loses places; a cut may have both."""
    # longs alone, so that Spark aggregates by hashing; both min_by see the rows alike, so they tell of one row
    place = (F.col("start").cast("long") * 128 + F.col("places")).alias("place")
    cuts = runs.select("key", "cut_hash", "_order", "_hash", place).groupBy("key", "cut_hash").agg(
        F.min("_order").alias("_order"), F.max("_order").alias("last"),
        F.min_by("_hash", "_order").alias("_hash"), F.min_by("place", "_order").alias("place"))
    cuts = written(cuts.withColumn("n", F.count("*").over(Window.partitionBy("key"))), "suffix-cuts", "zstd")
    schema = "key long, cut_hash long, first long, bits long"
    # a cut of several documents; a key's only cut shares no string with another cut
    shared = cuts.filter("last > _order").select("key", "cut_hash", F.col("_order").alias("first"), F.lit(0).cast("long").alias("bits"))
    wanted = cuts.filter("n > 1").select("key", "cut_hash", "_order", "_hash", F.expr("cast(place div 128 as int)").alias("start"),
                                         F.expr("cast(place % 128 as int)").alias("places"))
    several = written(with_bytes(wanted, docs).withColumn("shard", F.xxhash64("key")), "suffix-several", "zstd")
    size, = several.agg(F.sum(F.length("cut"))).first()
    shards = max(shuffles, -(-(size or 0) // SHARD))
    crowded = written(cuts.filter(F.col("n") > MANY).select("key").distinct(), "suffix-crowded")  # at most cuts / MANY keys

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        bits = lost_places(list(part["cut"]), part["first"].to_numpy(np.int64))
        lost = bits != 0
        return pd.DataFrame({"key": part["key"][lost], "cut_hash": part["cut_hash"][lost], "first": part["first"][lost],
                             "bits": bits[lost].view(np.int64)})

    few = several.join(crowded, "key", "left_anti").withColumn("shard", F.pmod("shard", F.lit(shards)))
    out = shared.unionByName(few.groupBy("shard").applyInPandas(sort, schema))
    if not crowded.limit(1).count():
        return out

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, cut_hash, first, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(len(cut) - LENGTH + 1):
                    h = xxhash.xxh3_128_intdigest(cut[i:i + LENGTH])
                    rows.append((key, cut_hash, first, i, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "cut_hash", "first", "i", "high", "low"])

    each = written(several.join(crowded, "key").select("key", "cut_hash", "first", "cut").mapInArrow(
        strings, "key long, cut_hash long, first long, i long, high long, low long"), "suffix-strings")
    least = each.groupBy("high", "low").agg(F.min("first").alias("least"))
    bit = F.expr("CASE WHEN first > least THEN shiftleft(1L, cast(i as int)) ELSE 0L END")
    more = each.join(least, ["high", "low"]).groupBy("key", "cut_hash", "first").agg(F.bit_or(bit).alias("bits"))
    return out.unionByName(more.filter("bits <> 0"))


def lost_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_order, _hash, runs): per document that loses bytes, the starts of runs and the bits of their lost places."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(shuffles, -(-size // (18 * SHARD)))  # a run for every 18 bytes
    runs = written(repeating_runs(texts, shards), "suffix-runs", "zstd")
    verdict = written(judged(runs, texts, shuffles), "suffix-verdicts", "zstd")
    every = F.expr("shiftrightunsigned(-1L, 64 - places)")
    bits = F.when(F.col("_order") > F.col("first"), every).otherwise(F.col("bits"))
    return (runs.join(verdict, ["key", "cut_hash"]).select("_order", "_hash", "start", bits.alias("bits"))
            .filter("bits <> 0").groupBy("_order", "_hash").agg(F.collect_list(F.struct("start", "bits")).alias("runs")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): every row of ``docs`` whole in ``row``, beside its remaining bytes."""
    lost = written(lost_runs(docs, id_col, text_col), "suffix-lost")
    rows = docs.select(F.struct("*").alias("row"), *document_key(id_col, text_col))
    joined = rows.join(lost, ["_order", "_hash"], "left").select("row", F.coalesce(F.col(f"row.{text_col}"), F.lit("")).alias("_t"), "runs")

    @F.pandas_udf("struct<kept:binary,n_bytes:long,n_removed:long,n_spans:long>")
    def cut(texts: pd.Series, starts: pd.Series, bits: pd.Series) -> pd.DataFrame:
        out = []
        for text, at, marks in zip(texts, starts, bits, strict=True):
            text = text.encode()
            if at is None:
                out.append((text, len(text), 0, 0))
                continue
            each = (np.asarray(marks, np.int64).view(np.uint64)[:, None] >> np.arange(PLACES, dtype=np.uint64)) & np.uint64(1)
            row, place = np.nonzero(each)
            edges = np.zeros(len(text) + 1, np.int64)
            begin = np.unique(np.asarray(at, np.int64)[row] + place)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + LENGTH, -1)
            gone = np.cumsum(edges[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), int(gone.sum()), spans))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    return joined.withColumn("_cut", cut("_t", "runs.start", "runs.bits")).select("row", "_cut.*")


def removal_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
