"""Quality rules with risk-controlled cutoffs.

Every rule is a number per document, larger being worse, with cutoffs that are
tried in one fixed order (``STEPS``), the ones that good prose hardly ever meets
first. Step j rejects a document if any cutoff of the steps up to j does. For
each stratum (language) the good documents among the labelled ones that step j
rejects are counted: k of n. The step is certified if all before it are and
P(Binomial(n, risk) <= k) <= delta / m, with m the number of strata. That is the
same as a Clopper-Pearson upper bound of at most ``risk``. Testing in a fixed
order that ends at the first failure needs no correction within a stratum, and
Bonferroni's covers the strata: with probability 1 - delta no stratum rejects
more than ``risk`` of its good documents by all certified cutoffs together, nor
by any choice among them. Of a rule's certified cutoffs the one that catches
most bad documents is used (ties: the loosest), if it catches more than
``GAIN`` bad ones for each good one. With four languages a language needs some
86 good labels, or 129 if one of them is rejected; one with fewer rejects by the
base rules alone.

Everything is built-in expressions and joins. Texts are read whole; a document
costs no shuffle. The labels may be as many as the documents: only counts per
stratum are gathered, and every label counts.

Defined results: null texts have no words and fail the base rules; null strata
are one stratum; repeated rows are judged row by row; of repeated labels the
worst counts, null labels and labels without a document don't; a null id has no
label but gets a verdict; empty tables give empty results; other columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import WHITE, split_words, written

#: Rule: its value as an expression over the counts
RULES = {
    "symbols": "100 * n_symbols / word_chars",
    "repeats": "100 * n_repeat_words / n_words",
    "dup_lines": "100 * n_dup_lines / n_lines",
    "capitals": "100 * n_capitals / word_chars",
    "bangs": "100 * n_bangs / n_words",
}
#: The steps in their fixed order: (rule, cutoff), a rule's cutoffs from the loosest.
STEPS = (("symbols", 20), ("bangs", 50), ("capitals", 50), ("symbols", 10), ("bangs", 20), ("capitals", 30), ("symbols", 5),
         ("bangs", 10), ("symbols", 2), ("dup_lines", 50), ("capitals", 20), ("symbols", 1), ("bangs", 5), ("dup_lines", 30),
         ("repeats", 15), ("capitals", 10), ("dup_lines", 20), ("repeats", 10), ("dup_lines", 10), ("repeats", 5))
GAIN = 4  # bad documents that a cutoff has to catch for each good one
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
MAX_BROADCAST = 2_000_000  # rejected rows (id, language, hash) that are broadcast; more are joined by shuffle
MAX_STRATA = 10_000  # rows of cutoffs that are broadcast; more are joined by shuffle


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, counts): every row of ``docs`` in the struct ``row`` beside its counts."""
    t, w = F.col("_t"), F.col("_w")
    kept = lambda c: F.length(F.regexp_replace(t, c, "")).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("row", "_t", split_words(t, WHITE).alias("_w"),
                       F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.slice(w, i, F.lit(WINDOW))
    rows = rows.select(
        "row", "_w", F.size(w).cast("long").alias("n_words"), kept(WHITE).alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        .alias("n_dup_lines"), F.size("_lines").cast("long").alias("n_lines"), kept("[^A-Z]+").alias("n_capitals"),
        kept("[^!]+").alias("n_bangs"), F.transform(starts, lambda i: F.xxhash64(run(i))).alias("_hashes"))
    # windows with different hashes differ; only texts with equal hashes compare the windows themselves
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_sorted", F.when(again, F.sort_array(F.transform(
        starts, lambda i: F.struct(F.array_join(run(i), " ").alias("s"), i.alias("i"))))))
    beside = lambda x, k: F.coalesce(F.get("_sorted", k)["s"] == x["s"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_sorted", lambda x, k: beside(x, k - 1) | beside(x, k + 1)),
                                      lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct(
        (a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return rows.select("row", *COUNTS[:4], "n_lines", "n_capitals", "n_bangs",
                       F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def value(rule: str) -> Column:
    """A rule's number; 0 where its divisor is."""
    above, below = RULES[rule].split(" / ")
    return F.when(F.col(below) > 0, F.expr(above) / F.col(below)).otherwise(F.lit(0.0))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted up so that its error is below 1e-12."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) \
        + 1 / (1260 * F.pow(x, F.lit(5.0)))
    up = F.lit(1.0)
    for j in range(1, 9):
        up = up * (n + j)
    return series - F.log(up)


def binomial_tail(k: Column, n: Column, p: Column, terms: int = 2000) -> Column:
    """P(Binomial(n, p) <= k), for k below n * p; else 1.

    Terms are added from the k-th down, where they fall at least geometrically; beyond ``terms`` of them
    the rest is bounded by the geometric series, so the value never comes out too small.
    """
    odds = (1 - p) / p
    ratio = lambda j: (k - j + 1) / (n - k + j) * odds
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(terms)).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["sum"] + a["term"] * ratio(j)).alias("sum")),
        lambda a: a["sum"] + F.when(k > terms, a["term"] * ratio(F.lit(terms)) / (1 - ratio(F.lit(terms)))).otherwise(0.0))
    return F.when(k < n * p, F.exp(first) * total).otherwise(F.lit(1.0))


def certified_cutoffs(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, one column per rule): the cutoffs in use, null where none is certified, from rows of
    (stratum, good, counts)."""
    good = F.col("good")
    hits = lambda r, c, who: F.sum((who & (value(r) > c)).cast("long"))
    # the first step that rejects a row; rows that the base rules reject anyway don't count
    first = F.coalesce(*(F.when(value(r) > c, F.lit(j)) for j, (r, c) in enumerate(STEPS)), F.lit(len(STEPS)))
    counts = labelled.filter(~base_failed()).withColumn("_first", first).groupBy("stratum").agg(
        F.sum(good.cast("long")).alias("n"),
        F.array(*(F.struct(F.lit(j).alias("step"), F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"),
                           F.sum((good & (F.col("_first") <= j)).cast("long")).alias("k_all"), hits(r, c, good).alias("k"),
                           hits(r, c, ~good).alias("bad")) for j, (r, c) in enumerate(STEPS))).alias("tests"))
    counts = written(counts, "quality-counts")
    strata = F.lit(float(max(1, counts.count())))
    rows = counts.select("stratum", "n", F.inline("tests"))
    sure = binomial_tail(F.col("k_all"), F.col("n"), F.lit(risk)) <= F.lit(delta) / strata
    failed = F.min(F.when(~sure, F.col("step"))).over(Window.partitionBy("stratum"))  # over the rows of a stratum's steps
    rows = rows.withColumn("sure", F.col("step") < F.coalesce(failed, F.lit(len(STEPS))))
    best = F.max(F.when(F.col("sure") & (F.col("bad") > GAIN * F.col("k")), F.struct("bad", "cutoff")))
    return rows.groupBy("stratum").pivot("rule", list(RULES)).agg(best["cutoff"])


def labelled_rows(counted: DataFrame, labels: DataFrame, id_col: str, stratum: Column) -> DataFrame:
    """The counted rows that have a label, with ``good`` and their stratum."""
    worst = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("good")))
    return (counted.withColumn("stratum", stratum).join(worst, F.col(id_col) == F.col("_id")).drop("_id"))


def judged(counted: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """``counted`` with base_failed and kept."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_cut_{r}") for r in RULES))
    cuts = written(cuts, "quality-cutoffs")
    if cuts.count() <= MAX_STRATA:
        cuts = F.broadcast(cuts)
    rows = counted.join(cuts, stratum.eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(value(r) > F.col(f"_cut_{r}"), F.lit(False))
    return (rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
            .drop("_stratum", *(f"_cut_{r}" for r in RULES)))


def judged_table(docs: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(doc_id, stratum, _hash, counts, base_failed, kept) per row of ``docs``; texts are read once, their counts written."""
    rows = docs.select("doc_id", "text", F.col("lang").alias("stratum"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    counted = with_counts(rows)
    counted = written(counted.select("row.doc_id", "row.stratum", "row._hash", *(c for c in counted.columns if c != "row")), "quality")
    cutoffs = certified_cutoffs(labelled_rows(counted, labels, "doc_id", F.col("stratum")), risk, delta)
    return judged(counted, cutoffs, F.col("stratum"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    return judged_table(docs, labels, risk, delta).select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``docs`` without the rejected rows, which are told by id, language and text hash; columns and other rows unchanged."""
    gone = judged_table(docs, labels, risk, delta).filter(~F.col("kept"))
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("stratum").alias("_stratum"), "_hash").distinct(), "quality-gone")
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    same = (F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_lang").eqNullSafe(F.col("_stratum"))
            & (F.col("_h") == F.col("_hash")))
    return rows.join(gone, same, "left_anti").select("row.*")


def oracle_sql(risk: float = 0.05, delta: float = 0.05) -> str:
    """The same verdicts in DuckDB's SQL, with log-gamma binomial sums."""
    ratio = lambda r: "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE 0 END".format(*RULES[r].split(" / "))
    grid = ", ".join(f"({j}, '{r}', CAST({c} AS DOUBLE))" for j, (r, c) in enumerate(STEPS))
    long = " UNION ALL ".join(f"SELECT r, stratum, base_failed, '{r}' AS rule, {ratio(r)} AS x FROM v" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
starts AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
runs AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS run FROM starts),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) q WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) q GROUP BY r),
c AS (SELECT w.r, doc_id, lang AS stratum, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.r = rep.r),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
x AS ({long}),
worst AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
fit AS (SELECT v.r, good FROM v JOIN worst ON v.doc_id = worst.doc_id WHERE NOT base_failed),
grid AS (SELECT * FROM (VALUES {grid}) g(step, rule, cutoff)),
hit AS (SELECT fit.r, stratum, good, step, x.rule, cutoff, x > cutoff AS hit,
  bool_or(x > cutoff) OVER (PARTITION BY fit.r ORDER BY step) AS any_hit
  FROM fit JOIN x ON fit.r = x.r JOIN grid ON x.rule = grid.rule),
tests AS (SELECT stratum, step, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND any_hit) AS k_all,
  count(*) FILTER (WHERE good AND hit) AS k, count(*) FILTER (WHERE NOT good AND hit) AS bad FROM hit GROUP BY 1, 2, 3, 4),
tails AS (SELECT *, CASE WHEN k_all < n * {risk} THEN list_sum(list_transform(range(0, k_all + 1), lambda i: exp(
  lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) ELSE 1 END AS p FROM tests),
ends AS (SELECT *, min(CASE WHEN p > {delta} / (SELECT count(DISTINCT coalesce('=' || stratum, '')) FROM tests) THEN step END)
  OVER (PARTITION BY stratum) AS failed FROM tails),
sure AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, cutoff DESC) AS o
  FROM ends WHERE bad > {GAIN} * k AND step < coalesce(failed, {len(STEPS)})),
gone AS (SELECT DISTINCT x.r FROM x JOIN sure ON o = 1 AND x.rule = sure.rule AND x.stratum IS NOT DISTINCT FROM sure.stratum
  WHERE x > cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND gone.r IS NULL AS kept
FROM v LEFT JOIN gone ON v.r = gone.r
"""
