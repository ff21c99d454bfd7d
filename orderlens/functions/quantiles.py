"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` keeps every distinct value of the column in one
aggregation buffer for a global quantile — unbounded at scale. Here the exact
linear-interpolated quantile (same definition: position = p·(n−1)) is found by
counting, for all probabilities together, in two scans:

1. values are counted by bin, a bin being a fixed share of a doubling of the
   value, so there are some tens of thousands of bins however many rows; the
   running counts tell in which bins the wanted ranks lie;
2. the values in those few bins are counted one by one (a value repeated on a
   third of the table is one row with its count) and their running counts give
   the order statistics.

Both counts are partial before the shuffle. A bin can't be missed, so there is
nothing to fail. A bin's distinct values, the only rows that are ordered in one
task, are bounded by the column's resolution: for money with four decimals up
to 10⁶ fewer than 10⁶ values. Only the chosen bins and the order statistics
reach the driver.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 4096


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], accuracy: int = ACCURACY) -> dict[float, Column]:
    """The exact p-quantiles (linear interpolation, as Spark's ``percentile``) of ``value`` over ``df`` as literal
    Columns; ``accuracy``: bins per doubling of the value."""
    v = F.col("v")
    base = df.select(value.cast("double").alias("v")).where(v.isNotNull())
    # grows with the value, equal for equal values
    base = base.withColumn("bin", F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * accuracy).cast("long"))
    running = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, 0)
    bins = base.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).withColumns({
        "upto": F.sum("k").over(running().orderBy("bin")), "n": F.sum("k").over(Window.partitionBy())})
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = [r(place(p)) for p in probs for r in (F.floor, F.ceil)]
    holds = [(F.col("upto") - F.col("k") <= r) & (r < F.col("upto")) for r in ranks]
    hit = bins.where(functools.reduce(operator.or_, holds)).collect()   # at most two bins per probability
    if not hit:
        return {p: F.lit(None).cast("double") for p in probs}
    n = hit[0]["n"]
    before = F.create_map(*(F.lit(x) for r in hit for x in (r["bin"], r["upto"] - r["k"])))
    counted = base.where(F.col("bin").isin([r["bin"] for r in hit])).groupBy("bin", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(running("bin").orderBy("v")) + before[F.col("bin")]
    wanted = [(n - 1) * float(p) for p in probs]
    got = counted.withColumn("upto", upto).agg(*(
        F.min(F.when(F.col("upto") > r(x), v)).alias(f"{name}{i}")
        for i, x in enumerate(wanted) for name, r in (("low", math.floor), ("high", math.ceil)))).first()
    out = {}
    for i, (p, x) in enumerate(zip(probs, wanted, strict=True)):
        low, high = got[f"low{i}"], got[f"high{i}"]
        out[p] = F.lit(low if math.floor(x) == math.ceil(x) else low + (x - math.floor(x)) * (high - low)).cast("double")
    return out


def exact_quantile(df: DataFrame, value: Column, p: float, accuracy: int = ACCURACY) -> Column:
    """The exact p-quantile (linear interpolation) of ``value`` over ``df``."""
    return exact_quantiles(df, value, [p], accuracy)[p]
