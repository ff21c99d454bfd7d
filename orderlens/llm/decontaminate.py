"""Benchmark decontamination: hashes of item windows are broadcast, document windows look themselves up.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other
characters from U+0080 on. An item's windows are its 10 consecutive words, or
all of its words if there are fewer. A document's windows are hashed in place
and looked up in a bitmap of the items' hashes; those found there become rows
and are verified by joining the items' windows on their words. Hits are
gathered per document as intervals.

The item table is broadcast only while it has at most ``MAX_BROADCAST``
windows; a larger one is joined by shuffle, where Spark splits skewed keys.
Everything is built-in expressions and joins.

A document row is known by its id and its text's hash; equal rows are told
once and joined back to each. Defined results: null texts have no words; a null
id stays null; empty tables give empty results (no items: nothing is hit);
items with null or wordless text have no window; an item without an id hits but
is not listed; repeated item ids count once;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import ascii_lower, digest_of_strings, split_words, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_BROADCAST = 400_000  # windows, about 100 bytes each
MAX_CELLS = 1 << 16  # of 64 bits: 512 KB in the plan


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD)


def windows_of(words_: Column, n: int, bits: Column, mask: int) -> Column:
    """Array of (at, n, h): the runs of ``n`` words, by place from 1 on and hash, whose hash has its bit set."""
    last = F.size(words_) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    every = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"),
                                                   F.xxhash64(F.slice(words_, i, F.lit(n))).alias("h")))
    cell = lambda h: F.get(bits, h.bitwiseAND(F.lit(mask)).cast("int"))
    bit = lambda h: F.call_function("shiftright", cell(h), F.shiftrightunsigned(h, 58).cast("int"))
    return F.filter(every, lambda s: bit(s["h"]).bitwiseAND(F.lit(1).cast("long")) == 1)


def hash_bits(items: DataFrame, n_windows: int) -> tuple[Column, int]:
    """A set of the windows' hashes as a bitmap literal: one cell of 64 bits per window, at most ``MAX_CELLS``.

    It only spares rows: what passes is joined with the windows themselves. Beyond that size it passes more.
    """
    cells = min(MAX_CELLS, 1 << max(6, n_windows.bit_length()))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
    rows = (items.select(F.col("h").bitwiseAND(F.lit(cells - 1)).cast("int").alias("cell"), bit.alias("bit"))
            .groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect())  # at most ``cells`` rows
    table = dict.fromkeys(range(cells), 0) | {r.cell: r.bits for r in rows}
    return F.split(F.lit(",".join(map(str, table.values()))), ",").cast("array<bigint>"), cells - 1


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, h, run): an item's windows with their words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
    runs = items.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("_w", i, n))).alias("_r"))
    return runs.select("item_id", "n", F.xxhash64("_r").alias("h"), F.array_join("_r", " ").alias("run")).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct document row (id, _text_hash): n_words, n_hit, hits (sorted intervals of words), items.

    Every document sends one row with its number of words besides its hits, so that one pass does for both.
    """
    items = written(item_windows(benchmark, window), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most ``window`` values
    marker = docs.sparkSession.range(1).select(F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_h"), F.lit("").alias("_run"))
    n_windows = items.count()
    bits, mask = hash_bits(items, n_windows)
    known = items.select(F.col("n").alias("_n"), F.col("h").alias("_h"), F.col("run").alias("_run")).distinct()
    known = known.unionByName(marker)
    if n_windows <= max_broadcast:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"),
                       words(F.col(text_col)).alias("_w"))
    rows = rows.select("*", F.concat(F.array().cast("array<struct<at:int,n:int,h:bigint>>"),
                                     *(windows_of(F.col("_w"), n, bits, mask) for n in lengths)).alias("_found"))
    with_words = F.transform("_found", lambda s: F.struct(
        s["at"].alias("at"), s["n"].alias("n"), s["h"].alias("h"), F.array_join(F.slice("_w", s["at"], s["n"]), " ").alias("run")))
    counted = F.array(F.struct(F.size("_w").alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("h"),
                               F.lit("").alias("run")))
    found = rows.select("_id", "_text_hash", F.inline(F.concat(counted, with_words)))
    hits = found.join(known, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & (F.col("run") == F.col("_run")))
    by_doc = hits.groupBy("_id", "_text_hash").agg(
        F.max(F.when(F.col("n") == 0, F.col("at"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.struct("at", (F.col("at") + F.col("n")).alias("end")))))
        .alias("hits"),
        F.collect_set(F.when(F.col("n") > 0, F.col("run"))).alias("_runs"))  # bounded by one document's words
    by_doc = written(by_doc, "hits")
    # items by the runs that a document holds: each run once per document
    told = (by_doc.select(F.col("_id").alias("_id2"), F.col("_text_hash").alias("_hash2"), F.explode("_runs").alias("run"))
            .join(items.select("run", "item_id"), "run").groupBy("_id2", "_hash2")
            .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    keys = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text_hash") == F.col("_hash2"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["at"], a["end"]), F.lit(0))).alias("n"),
                              F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
    return by_doc.join(told, keys, "left").select(
        "_id", "_text_hash", "n_words", covered.alias("n_hit"), "hits",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def joined_back(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, then the columns of ``found``): ``found`` beside every row of ``docs``, kept whole in the struct ``row``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_doc"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash"))
    return rows.join(found, same).select("row", *(c for c in found.columns if c not in ("_id", "_text_hash")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    found = occurrences(docs, benchmark)
    ids = docs.select("doc_id", "text")
    return joined_back(ids, found).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest_of_strings(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of any item; columns and other rows unchanged."""
    hit = occurrences(docs, benchmark).filter("n_hit > 0").select("_id", "_text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash"))
    return rows.join(hit, same, "left_anti").select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, kept_words): the normalised words of every document without those inside a hit."""
    found = occurrences(docs, benchmark)
    kept = F.filter(words(F.col("row.text")), lambda w, i: ~F.exists(
        "hits", lambda s: (s["at"] <= i + 1) & (i + 1 < s["end"])))
    return joined_back(docs.select("doc_id", "text"), found).select("row.doc_id", kept.alias("kept_words"))


#: DuckDB's words and windows of the same rules; hits by joining the windows' words themselves.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM b WHERE len(w) > 0),
runs AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run FROM starts),
lens AS (SELECT DISTINCT n FROM runs),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT spots.r, spots.i, spots.n, runs.item_id FROM spots JOIN runs
  ON spots.n = runs.n AND array_to_string(list_slice(spots.w, spots.i, spots.i + spots.n - 1), ' ') = runs.run),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM
  (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM
  (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
