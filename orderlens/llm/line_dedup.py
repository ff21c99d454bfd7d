"""Line dedup by a sharded minimal perfect hash over the distinct lines.

A line's key is the line without white space at both ends, A-Z lower-cased,
and is known by a 128-bit hash. Keys of ``min_length`` code points found in
``min_docs`` documents lose their lines everywhere but in the document with the
largest id that holds them.

1. Every document tells its distinct keys; partial sums meet before the
   shuffle, so a line that is everywhere costs one row per task.
2. Keys are dealt to shards by hash. A shard's keys get a minimal perfect hash
   (levels of bit arrays, as many slots as keys) that indexes compact arrays:
   fingerprints, saturated document counts and owners.
3. Documents send their keys to the shards, which answer from the arrays; only
   lines to be dropped come back. No text and no line is joined with a line.

Keys that more than ``1 / (8 * shards)`` and more than ``1 / HOT`` of all probes
ask for can't number more than the lesser of ``8 * shards`` and ``HOT``; these
hot keys have an index of their own, at most some 30 MB at any input size, which
goes to every task, so that no shard gets their probes. Shards therefore hold
about ``SHARD`` probes each, and any other key adds at most a ``HOT``-th of all
probes to its shard (two million of 10^12).

Documents are known by id and text hash: equal rows get the same answer. Every
row counts as a document of its own. Defined results: null and empty texts have one empty
line; a null id is smaller than any other and, if a key has no other owner,
keeps it; empty tables give empty results; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import written

SHARD = 200_000  # probes a shard
HOT = 500_000  # keys that every task may hold
SPACE = b" \t\n\x0b\x0c\r"
M64 = (1 << 64) - 1


def key_hash(line: bytes, min_length: int) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key as two signed numbers; None for a short key."""
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode()) < min_length:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & M64) - (1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: per level a bit array in which only lone keys settle.

    A key's slot is the number of bits before its own over all levels; a key that wasn't put in may get any slot, or -1.
    """

    def __init__(self, levels: list[np.ndarray], spare: float = 2.0):
        self.levels, self.spare = levels, spare
        self.ranks, n = [], 0
        for bits in levels:
            before = np.cumsum(bits, dtype=np.int64) - bits
            self.ranks.append(before + n)
            n += int(bits.sum())
        self.size = n

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spare: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            size = int(len(keys) * spare) + 1
            at = cls.place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, spare)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[open_], level, len(bits))
            here = bits[at]
            out[open_[here]] = self.ranks[level][at[here]]
            open_ = open_[~here]
        return out


class LineIndex:
    """Fingerprints, counts and owners of one shard's keys, found through a perfect hash.

    Keys whose first 64 bits clash are told apart by the hash being taken over both halves.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, owners: np.ndarray, owned: np.ndarray,
                 most: int = 255):
        keys = self.mixed(high, low)
        self.hash = PerfectHash.build(np.unique(keys))
        slot = self.hash.slots(keys)
        self.prints = np.zeros(self.hash.size, np.uint64)
        self.counts = np.zeros(self.hash.size, np.min_scalar_type(most))
        self.owners = np.zeros(self.hash.size, np.int64)
        self.owned = np.zeros(self.hash.size, bool)
        self.prints[slot] = high.view(np.uint64)
        self.counts[slot] = np.minimum(counts, most)
        self.owners[slot], self.owned[slot] = owners, owned

    @staticmethod
    def mixed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return high.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ low.view(np.uint64)

    def drops(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes (a key in the document ``ids``, if ``known``) lose their lines."""
        if not self.hash.size:
            return np.zeros(len(high), bool)
        slot = self.hash.slots(self.mixed(high, low))
        same = (slot >= 0) & (self.prints[slot] == high.view(np.uint64))
        elsewhere = self.owned[slot] & (~known | (ids != self.owners[slot]))
        return same & (self.counts[slot] >= min_docs) & elsewhere


PROBE = "_id long, _hash long, high long, low long"


def probes(docs: DataFrame, min_length: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, high, low): the distinct long keys of every document."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = {k for line in text.encode().split(b"\n") if (k := key_hash(line, min_length))}
                rows.extend((i, h, *k) for k in keys)
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_hash", "high", "low"])

    texts = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
                        F.coalesce(F.col(text_col), F.lit("")))
    return texts.mapInArrow(told, PROBE)


def lost_keys(docs: DataFrame, min_docs: int = 3, min_length: int = 20, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(_id, _hash, lost): per distinct document row that loses lines, the keys (high, low) of these."""
    spark = docs.sparkSession
    asked = written(probes(docs, min_length, id_col, text_col), "line-probes")
    keys = written(asked.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("_id").alias("owner")), "line-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    often = max(total // (8 * shards), -(-total // HOT), min_docs)
    # at most min(8 * shards, HOT) rows: their counts add up to no more than the total
    hot_rows = keys.filter(F.col("n") > often).toPandas()
    hot = spark.sparkContext.broadcast(index_of(hot_rows, min_docs))
    hot_keys = spark.createDataFrame(hot_rows[["high", "low"]], "high long, low long")

    def answered_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.to_pandas()
            yield batch.filter(pa.array(drops_of(hot.value, part, min_docs)))

    def answered(_: tuple, own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return part.loc[drops_of(index_of(own, min_docs), part, min_docs), ["_id", "_hash", "high", "low"]]

    shard = F.pmod(F.col("low"), F.lit(shards)).alias("_shard")
    from_hot = asked.mapInArrow(answered_here, PROBE)
    rest = asked.join(F.broadcast(hot_keys), ["high", "low"], "left_anti").select("*", shard)
    own = keys.filter(F.col("n") <= often).select("*", shard)
    from_shards = own.groupBy("_shard").cogroup(rest.groupBy("_shard")).applyInPandas(answered, PROBE)
    lost = from_hot.unionByName(from_shards)
    return lost.groupBy("_id", "_hash").agg(F.collect_set(F.struct("high", "low")).alias("lost"))


def index_of(rows: pd.DataFrame, min_docs: int) -> LineIndex:
    """The rows' index; counts saturate at no less than ``min_docs``."""
    owner = rows["owner"]
    return LineIndex(rows["high"].to_numpy(np.int64), rows["low"].to_numpy(np.int64), rows["n"].to_numpy(np.int64),
                     owner.fillna(0).to_numpy(np.int64), owner.notna().to_numpy(bool), max(255, min_docs))


def drops_of(index: LineIndex, part: pd.DataFrame, min_docs: int) -> np.ndarray:
    ids = part["_id"]
    return index.drops(part["high"].to_numpy(np.int64), part["low"].to_numpy(np.int64),
                       ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(bool), min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_length: int = 20, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped): every row of ``docs`` whole in ``row``, beside its text without the lost lines."""
    lost = lost_keys(docs, min_docs, min_length, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_h"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    joined = rows.join(lost, same, "left").select("row", F.coalesce(F.col(f"row.{text_col}"), F.lit("")).alias("_t"), "lost")

    @F.pandas_udf("struct<kept:string,n_lines:long,n_dropped:long>")
    def cut(texts: pd.Series, high: pd.Series, low: pd.Series) -> pd.DataFrame:
        out = []
        for text, hs, ls in zip(texts, high, low, strict=True):
            lines = text.split("\n")
            if hs is None:
                out.append((text, len(lines), 0))
                continue
            gone = set(zip(map(int, hs), map(int, ls), strict=True))
            kept = [x for x in lines if key_hash(x.encode(), min_length) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    return joined.withColumn("_cut", cut("_t", "lost.high", "lost.low")).select("row", "_cut.*")


def line_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text and n_chars (if there) counting them; other columns unchanged."""
    found = dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(F.when(F.col("n_dropped") > 0, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new
                          else F.col(f"row.{c}") for c in docs.columns))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, often.key IS NOT NULL AND often.owner IS NOT NULL AND k.doc_id IS DISTINCT FROM often.owner AS gone
  FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
