"""Mixing sources to target weights by fitting word budgets as subset sums.

1. One shuffle gives the number of documents of every (source, size): the only
   thing that is gathered, pre-aggregated, so a hot source costs no more.
2. A source's target is its weighted share of the whole budget, at most ``cap``
   times its size; the excess goes to the others by weight until none is above.
3. Each document can be taken up to ``cap`` times, so a size has that many
   copies of its documents. All but the last ``slack`` words of the target are
   filled with an even share of every size's copies; a bounded knapsack over the
   copies that are left, whose sums are the bits of one integer, fills the rest.
   So sums that leave one document out and double another are tried, too.
4. Which documents of a size are taken twice, once or not follows from seeded
   hashes: counts by hash prefix find the prefix where the quota ends and only
   within a prefix documents are ranked, so a size that a third of all rows
   share is spread over thousands of groups.

Defined results: null and empty texts have size 0 and are never taken; null
sources are one source, ordered last; repeated rows are documents of their own
and interchangeable; a rerun takes the same documents; other columns and the
order of rows don't matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import WHITE, split_words, written


def n_words(text: Column) -> Column:
    return F.size(split_words(text, WHITE)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(_key, source, source_size, target) from (_key, source, source_size): one row per source goes through one task.

    Sources stop at their cap in the order of cap over weight; the level for the
    rest is what is left of the budget over what is left of the weights. That is
    where the rounds of resharing end.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, map(float, weights)))
    rows = (sizes.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
            .withColumn("_cap", F.col("source_size") * F.lit(float(cap))))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), zero)
    level = left / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), zero))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    first_open = F.min(F.when(~F.col("_full"), F.col("_cap") / F.col("_weight"))).over(whole)
    end = F.max(F.when(F.col("_cap") / F.col("_weight") == first_open, F.col("_level"))).over(whole)
    target = F.when(F.col("_cap") / F.col("_weight") < first_open, F.col("_cap")).otherwise(end * F.col("_weight"))
    return rows.select("_key", "source", "source_size", F.coalesce(F.least(target, F.col("_cap")), F.col("_cap")).alias("target"))


def best_counts(sizes: list[int], counts: list[int], budget: int, enough: int) -> list[int]:
    """How many copies of each size to take, for a sum of at most ``budget`` and as near as can be.

    An even share of all but the last ``enough`` words first. What is left is
    filled from the largest size down while it exceeds ``enough``; then a bounded
    knapsack gives the best sum: bit s of an integer says that s can be reached,
    binary parts bound the counts, and the parts are walked back to find who made
    the best sum.
    """
    whole = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if budget >= whole:
        return list(counts)
    taken = [n * max(0, budget - enough) // whole for n in counts]
    left = budget - sum(s * n for s, n in zip(sizes, taken, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if left <= enough:
            break
        if sizes[i] and (more := min(counts[i] - taken[i], (left - enough) // sizes[i])) > 0:
            taken[i] += more
            left -= more * sizes[i]
    free = [(i, counts[i] - taken[i]) for i in reversed(order) if 0 < sizes[i] <= left and counts[i] > taken[i]]
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i, n in free:
        part = 1
        n = min(n, left // sizes[i])
        while n > 0 and not reach >> left & 1:
            part_n = min(part, n)
            steps.append((reach, i, part_n))
            reach |= reach << (part_n * sizes[i]) & mask
            n -= part_n
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, i, n in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * sizes[i]
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
        slack: int = 4096, keep: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(row, source, size, source_size, target, epochs, taken) per row of ``docs``, whose columns ``keep`` (all if not
    given) are the struct ``row``.

    ``epochs``: how often the document is taken; ``taken``: that times its size. ``slack``: the words that the
    knapsack handles at most, which bounds its memory.
    """
    top = int(cap)
    row = F.struct(*(keep or ["*"])).alias("row")
    rows = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"))
    rows = (rows.withColumn("_prefix", F.shiftrightunsigned("_hash", 52).cast("int"))
            .withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))  # a null source joins too
    counts = written(rows.groupBy("_key", "source", "size", "_prefix").agg(F.count("*").alias("n")), "mix-counts")
    by_size = written(counts.groupBy("_key", "source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    goal = targets(by_size.groupBy("_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                   weights, share, cap)

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = part["size"].tolist(), part["n"].tolist()
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        copies = [top * n if s else 0 for s, n in zip(sizes, counts, strict=True)]
        taken = best_counts(sizes, copies, min(int(target), top * whole), slack) if whole else [0] * len(sizes)
        return pd.DataFrame({"_key": part["_key"], "size": part["size"], "source_size": part["source_size"], "target": part["target"],
                             "base": [t // n for t, n in zip(taken, counts, strict=True)],
                             "more": [t % n for t, n in zip(taken, counts, strict=True)]})

    plan = written(  # a group holds one row per distinct size: bounded by the longest document
        by_size.drop("source").join(goal.drop("source"), "_key")
        .groupBy("_key").applyInPandas(
            fitted, "_key string, size long, source_size long, target double, base long, more long"), "mix-plan")
    # the hash prefix in which a size's quota ends, and how much of it is still open there
    run = Window.partitionBy("_key", "size").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = counts.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n", "source")
    quota = (prefixes.join(plan, ["_key", "size"])
             .select("_key", "size", "_prefix", "source_size", "target", "base", (F.col("more") - F.col("_before")).alias("_open")))
    rank = Window.partitionBy("_key", "size", "_prefix").orderBy("_hash", F.col("_id").asc_nulls_last())
    more = (F.row_number().over(rank) <= F.col("_open")).cast("long")
    chosen = rows.join(quota, ["_key", "size", "_prefix"]).withColumn("_more", more)
    epochs = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.col("_more")).cast("long")
    return chosen.select("row", "source", "size", "source_size", "target", epochs.alias("epochs"),
                         (epochs * F.col("size")).alias("taken"))
