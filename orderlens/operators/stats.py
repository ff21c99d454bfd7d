"""Callable metric functions over an order table.

These read the raw (un-enriched) order lines. Distributions are computed in
one grouping-sets pass; percentiles are exact (``percentile``, linear
interpolation) and their thresholds feed filters as scalar subqueries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import money, ratio, safe_pct
from ..functions.quantiles import exact_quantile, exact_quantiles

DISTRIBUTION_COLUMNS = ["order_status", "payment_mode", "marketplace", "state", "courier"]
# Fixed limits of the custom-metric input (name pattern and text length).
CUSTOM_NAME_PATTERN = r"^[A-Za-z_]\w*$"
CUSTOM_MAX_CHARS = 8000


def _num(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def aov(df: DataFrame) -> DataFrame:
    """Mean line amount, 2 places."""
    return df.agg(ratio(F.sum("total_amount"), F.count("total_amount")).alias("aov"))


def total_revenue(df: DataFrame) -> DataFrame:
    """T2."""
    return df.agg(money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"))


def order_count(df: DataFrame) -> DataFrame:
    """Rows."""
    return df.agg(F.count(F.lit(1)).alias("order_count"))


def distributions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """T4: value counts of several columns in ONE grouping-sets pass; null values dropped."""
    cols = cols or DISTRIBUTION_COLUMNS
    g = df.groupingSets([[c] for c in cols], *cols).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    n = len(cols)
    dim = F.lit(None).cast("string")
    for i, c in enumerate(cols):
        dim = F.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i), F.lit(c)).otherwise(dim)
    out = g.select(dim.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in cols]).alias("value"), "count")
    return out.where(F.col("value").isNotNull())


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """T5: the n most frequent values of a column (ties by value)."""
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return per.orderBy(F.col("count").desc(), F.col(col).asc()).limit(n).select(F.col(col).cast("string").alias("value"), "count")


def averages(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of each column (2 places); 0 when there are no values."""
    return df.agg(*[F.round(F.coalesce(F.avg(_num(c)), F.lit(0.0)), 2).alias(f"avg_{c}") for c in cols])


def conversion_rate(df: DataFrame, success_status: str = "Delivered") -> DataFrame:
    """Rows with exactly ``success_status`` ÷ rows."""
    return df.agg(F.round(safe_pct(F.count(F.when(F.col("order_status") == success_status, 1)), F.count(F.lit(1))), 2)
                  .alias("conversion_rate"))


def cod_vs_prepaid_exact(df: DataFrame) -> DataFrame:
    """Rows whose payment mode is exactly COD / exactly PrePaid: count, revenue, mean."""
    out = []
    for name, v in (("cod", "COD"), ("prepaid", "PrePaid")):
        m = F.col("payment_mode") == v
        out += [F.count(F.when(m, 1)).alias(f"{name}_count"),
                money(F.coalesce(F.sum(F.when(m, F.col("total_amount"))), F.lit(0))).alias(f"{name}_total_revenue"),
                ratio(F.sum(F.when(m, F.col("total_amount"))), F.count(F.when(m, F.col("total_amount"))))
                .alias(f"{name}_avg_order_value")]
    return df.agg(*out)


def statistical_summary(df: DataFrame, field: str) -> DataFrame:
    """Count, mean, median, sample std, min, max, q25, q75 of a numeric field."""
    v = _num(field)
    q = exact_quantiles(df, v, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(v).alias("count"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), 2).alias("mean"),
        F.round(F.coalesce(q[0.5], F.lit(0.0)), 2).alias("median"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias("std"),
        F.round(F.coalesce(F.min(v), F.lit(0.0)), 2).alias("min"), F.round(F.coalesce(F.max(v), F.lit(0.0)), 2).alias("max"),
        F.round(F.coalesce(q[0.25], F.lit(0.0)), 2).alias("q25"),
        F.round(F.coalesce(q[0.75], F.lit(0.0)), 2).alias("q75"))


def percentile_of(df: DataFrame, field: str, p: float) -> DataFrame:
    """The p-th percentile (0–100), 2 places."""
    return df.agg(F.round(F.coalesce(exact_quantile(df, _num(field), p / 100.0), F.lit(0.0)), 2).alias("value"))


def tail_percentile(df: DataFrame, field: str, p: float, top: bool) -> DataFrame:
    """T14 (top, p=95) / T15 (bottom, p=5): threshold, rows beyond it, their share of rows, their total."""
    v = _num(field)
    threshold = exact_quantile(df, v, p / 100.0)
    hit = (v >= threshold) if top else (v <= threshold)
    return df.agg(
        F.round(F.coalesce(threshold, F.lit(0.0)), 2).alias("threshold"),
        F.count(F.when(hit, 1)).alias("count"),
        F.round(safe_pct(F.count(F.when(hit, 1)), F.count(F.lit(1))), 2).alias("percentage"),
        F.round(F.coalesce(F.sum(F.when(hit, v)), F.lit(0.0)), 2).alias("total_value"))


def correlation_matrix(df: DataFrame, fields: list[str]) -> DataFrame:
    """Pairwise Pearson correlation (pairwise-complete rows), 3 places, long form.

    Computed from moments so that a zero-variance column gives null instead
    of an ANSI divide-by-zero error; all-null columns are dropped.
    """
    nums = {f: _num(f) for f in fields}
    aggs = [F.count(c).alias(f"n_{i}") for i, c in enumerate(nums.values())]
    pairs = []
    for i, a in enumerate(fields):
        for j, b in enumerate(fields):
            both = nums[a].isNotNull() & nums[b].isNotNull()
            x, y = F.when(both, nums[a]), F.when(both, nums[b])
            aggs.append(F.round(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), 3)
                        .alias(f"c_{i}_{j}"))
            pairs.append(F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"c_{i}_{j}").alias("corr"),
                                  ((F.col(f"n_{i}") > 0) & (F.col(f"n_{j}") > 0)).alias("_keep")))
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*pairs))).where("_keep").drop("_keep")


def geographic_insights(df: DataFrame, locality_col: str = "city", n: int = 5) -> DataFrame:
    """Six top-n lists (state / locality × rows, revenue, mean), on 2-place rounded values."""
    # both levels from one scan, stacked as (level, key); then three ranks per level over the places' own rows,
    # each cut to n in every task before its shuffle
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(col).cast("string").alias("key"))
        for level, col in (("state", "state"), ("city", locality_col))])).alias("k"), "total_amount")
    per = stacked.where(F.col("k.key").isNotNull()).groupBy("k.level", "k.key").agg(
        F.count("total_amount").cast("double").alias("orders"), money(F.sum("total_amount")).alias("revenue"),
        F.round(F.try_divide(F.sum("total_amount").cast("double"), F.count("total_amount").cast("double")), 2).alias("aov"))
    lists = per.select("level", "key", F.inline(F.array(*[
        F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"), F.col(m).alias("value"))
        for m, before, after in (("orders", "top_", "s_by_orders"), ("revenue", "top_", "s_by_revenue"),
                                 ("aov", "highest_aov_", "s"))])))
    lists = lists.select(F.concat("before", "level", "after").alias("list"), "key", "value")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.col("value").desc(), F.col("key").asc()))
    return lists.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def cancelled_count(df: DataFrame) -> DataFrame:
    """Rows with status exactly Cancelled."""
    return df.agg(F.count(F.when(F.col("order_status") == "Cancelled", 1)).alias("cancel_count"))


COMMON_DISTRIBUTIONS = ["order_status", "payment_mode", "marketplace"]


def common_metrics_with_distributions(df: DataFrame) -> DataFrame:
    """T9, whole: (metric, key, value) with AOV, revenue, row count, the amount summary (T12) and the status, payment
    and marketplace distributions (T4, one grouping-sets pass)."""
    row = statistical_summary(df, "total_amount")
    scalars = [("", df.agg(
        ratio(F.sum("total_amount"), F.count("total_amount")).alias("aov"),
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"),
        F.count(F.lit(1)).alias("order_count"))), ("total_amount_", row)]
    parts = [r.select(F.inline(F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.lit(None).cast("string").alias("key"),
                                                  F.col(c).cast("double").alias("value")) for c in r.columns])))
             for prefix, r in scalars]
    values = distributions(df, COMMON_DISTRIBUTIONS)
    parts.append(values.select(F.concat("dimension", F.lit("_distribution")).alias("metric"), F.col("value").alias("key"),
                               F.col("count").cast("double").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def common_metrics(df: DataFrame) -> DataFrame:
    """AOV, revenue, row count and the amount summary in one row."""
    v = F.col("total_amount").cast("double")
    q = exact_quantiles(df, v, [0.25, 0.5, 0.75])
    return df.agg(
        ratio(F.sum("total_amount"), F.count("total_amount")).alias("aov"),
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"),
        F.count(F.lit(1)).alias("order_count"),
        F.round(q[0.5], 2).alias("amount_median"),
        F.round(F.stddev_samp(v), 2).alias("amount_std"),
        F.round(q[0.25], 2).alias("amount_q25"),
        F.round(q[0.75], 2).alias("amount_q75"))


def column_values(df: DataFrame) -> DataFrame:
    """T18 (values): (column, value, n): every value of every column with its count; nulls are left out.

    All columns are stacked and counted in one shuffle, with partial counts
    before it. No list of values is gathered, so a column may have any number.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("kv"))
    return stacked.select("kv.*").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, categorical_max: int = 20, top: int = 5) -> DataFrame:
    """Every value of every column with its count ``n``, beside the column's type, non-null and distinct count,
    example (its least value), categorical flag and its ``top`` most frequent values (ties by value) as ``value (n)``,
    joined by ``; ``. A column without a value has one row, with zeros and a null value.

    Two phases: exact counts per value, dealt by (column, value); then numbers
    per column from those counts and, with the rank limit applied in every task
    before the shuffle, ``top`` rows per column, both joined back to the values.
    """
    types = dict(df.dtypes)
    counts = column_values(df)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc()))
    tops = (counts.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("_r", F.format_string("%s (%d)", "value", "n").alias("t")))).alias("_t")))
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("non_null"),
                                       F.min("value").alias("example"))
    names = df.sparkSession.createDataFrame([(c, types[c]) for c in df.columns], "column string, dtype string")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    columns = (names.join(F.broadcast(per), "column", "left").join(F.broadcast(tops), "column", "left")   # a row per column
               .select("column", "dtype", n("non_null").alias("non_null"), n("distinct_count").alias("distinct_count"),
                       "example", (n("distinct_count") <= categorical_max).alias("is_categorical"),
                       F.array_join("_t.t", "; ").alias("top_values")))
    none = columns.where(F.col("distinct_count") == 0).select(
        "*", F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n"))
    return counts.join(F.broadcast(columns), "column").select(*none.columns).unionByName(none)


def custom_metric(df: DataFrame, expression: str, name: str = "custom_metric") -> DataFrame:
    """A user-supplied SQL aggregate expression evaluated by Spark.

    The name must be an identifier and the text at most 8,000 characters; a
    null result fails the job with a clear error.
    """
    if not re.match(CUSTOM_NAME_PATTERN, name or ""):
        raise ValueError(f"invalid metric name {name!r}")
    if not expression or len(expression) > CUSTOM_MAX_CHARS:
        raise ValueError("expression is empty or longer than 8000 characters")
    v = F.expr(expression)
    return df.agg(v.alias("_v")).select(
        F.when(F.col("_v").isNull(), F.raise_error(F.lit(f"custom metric {name} evaluated to null")))
        .otherwise(F.col("_v")).alias(name))
