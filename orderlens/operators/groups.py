"""User-defined group comparison.

X1 tags every row with the ids of all groups whose filter spec it satisfies
in ONE scan (``explode`` of the matching ids — overlapping groups duplicate a
row once per group, bounded by the number of groups). Comparisons work on the
per-group aggregate, whose size is the number of groups in the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_filters
from .paycycle import RISK_CYCLE, RISK_MARGIN, _n, metric_columns
from .profit import profit_summary


def group_condition(filters: dict, nested_fields=()) -> Column:
    """One group's predicate: ``{column: value}`` is case-insensitive equality;
    ``{column: {operator, value}}`` uses that operator (Q26)."""
    specs = []
    for field, v in (filters or {}).items():
        if isinstance(v, dict) and "operator" in v:
            specs.append({"field": field, "operator": v["operator"], "value": v.get("value")})
        else:
            specs.append({"field": field, "operator": "eq", "value": v})
    return compile_filters(specs, nested_fields)


def assign_groups(df: DataFrame, groups: list[dict], nested_fields=()) -> DataFrame:
    """Add ``group_id`` / ``group_index``; a row appears once per matching group."""
    tagged = F.array(*[F.when(group_condition(g.get("filters", {}), nested_fields),
                              F.struct(F.lit(g["group_id"]).alias("group_id"), F.lit(i).alias("group_index")))
                       for i, g in enumerate(groups)])
    return df.withColumn("_g", F.explode(F.filter(tagged, lambda x: x.isNotNull()))).select("*", "_g.*").drop("_g")


def group_order_metrics(grouped: DataFrame) -> DataFrame:
    """Per group order count, revenue and revenue ÷ count."""
    amt = F.coalesce(F.col("total_amount").cast("string").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    g = grouped.groupBy("group_id", "group_index").agg(F.count(F.lit(1)).alias("count"), F.sum(amt).alias("_rev"))
    return g.select("group_id", "group_index", "count", F.round(F.col("_rev"), 2).cast("double").alias("total_revenue"),
                    F.round(F.try_divide(F.col("_rev").cast("double"), F.col("count").cast("double")), 2)
                    .alias("avg_order_value"))


def group_distributions(grouped: DataFrame, cols=("payment_mode", "order_status", "city", "billing_state")) -> DataFrame:
    """Per group value counts of several columns (missing → Unknown), long form, one shuffle."""
    stacked = grouped.select("group_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value"))
        for c in cols])).alias("kv")).select("group_id", "kv.*")
    return stacked.groupBy("group_id", "dimension", "value").agg(F.count(F.lit(1)).alias("count"))


def group_profit_metrics(grouped_items: DataFrame) -> DataFrame:
    """X6 (aggregation): V6 summary per group."""
    return profit_summary(grouped_items, "group_id").join(
        grouped_items.select("group_id", "group_index").distinct(), "group_id")


def group_payment_cycle_metrics(grouped_sheet: DataFrame) -> DataFrame:
    """D1 to D8 per group (D5 as a count) in one aggregate: means, exposure, the payment-cycle histogram and the
    cash-discount statistics. Groups may overlap."""
    m, cyc = _n("margin"), _n("payment_cycle")
    return grouped_sheet.groupBy("group_id", "group_index").agg(
        F.count(F.lit(1)).alias("distributor_count"), *metric_columns(),
        F.count(F.when((m > RISK_MARGIN) & (cyc > RISK_CYCLE), 1)).alias("high_risk_count"))


def compare_groups(metrics: DataFrame, value_cols: list[str], n_groups: int,
                   lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Differences to the baseline (first group) and winners.

    Two groups → pairwise rules (the second group wins ties); more → the
    first group listed wins ties. ``lower_is_better`` columns pick the
    minimum (e.g. the lowest-risk group). The groups become one array in one
    row (a request-sized one), from which array functions take the baseline,
    the differences and the winners: the metrics are computed once.
    """
    tie_sign = 1 if n_groups == 2 else -1
    row = metrics.agg(F.sort_array(F.collect_list(F.struct("group_index", F.struct(*metrics.columns).alias("m")))).alias("g"))
    g = F.col("g")
    number = lambda m, c: F.coalesce(m[c].cast("double"), F.lit(0.0))

    def best(c: str) -> Column:
        """The winner's index: the greatest (value, tie) of all groups."""
        sign = -1.0 if c in lower_is_better else 1.0
        ranked = F.transform(g, lambda x: F.struct((number(x["m"], c) * sign).alias("v"), (x["group_index"] * tie_sign).alias("t")))
        return F.array_max(ranked)["t"] * tie_sign

    # baseline and winners once per row, not once per group
    row = row.where(F.size(g) > 0).select("g", *(c for v in value_cols for c in (
        number(F.get(g, F.lit(0))["m"], v).alias(f"_base_{v}"), best(v).alias(f"_best_{v}"))))
    rows = row.select(F.explode("g").alias("x"), *(c for c in row.columns if c != "g"))

    def compared(c: str) -> list[Column]:
        v, b = number(F.col("x.m"), c), F.col(f"_base_{c}")
        return [F.round(v - b, 4).alias(f"{c}_diff"),
                F.round(F.when(b > 0, (v - b) / b * 100.0).otherwise(0.0), 2).alias(f"{c}_diff_pct"),
                (F.col("x.group_index") == F.col(f"_best_{c}")).alias(f"{c}_winner")]

    return rows.select("x.m.*", *(c for v in value_cols for c in compared(v)))
