"""Shared aggregate building blocks (A1–A5).

Distinct-order rates use the *order-level pre-aggregate* (OLP): group by
``(dims…, order_id)`` with per-order flags, then group by ``dims`` and sum the
flags. Both steps are hash aggregates with map-side partial aggregation, so a
hot key is combined inside each map task before the shuffle, and several
"distinct orders with status X" counts cost one pass instead of an ``Expand``
per distinct expression.
"""

from __future__ import annotations

import functools
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import money, ratio, safe_pct
from ..functions.filters import status_in


def order_count(col: str = "order_id") -> Column:
    """A1: distinct orders."""
    return F.countDistinct(col)


def status_flag(statuses: Iterable[str]) -> Column:
    return F.when(status_in(statuses), 1).otherwise(0)


def order_level(df: DataFrame, dims: list[str], flags: Mapping[str, Column] | None = None,
                sums: Mapping[str, Column] | None = None) -> DataFrame:
    """OLP step 1: one row per (dims, order_id) with max(flag) and sums."""
    aggs = [F.max(c).alias(n) for n, c in (flags or {}).items()]
    aggs += [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    return df.groupBy(*dims, "order_id").agg(*aggs)


def status_order_counts(df: DataFrame, dims: list[str], status_sets: Mapping[str, Iterable[str]],
                        sums: Mapping[str, Column] | None = None) -> DataFrame:
    """A2 for several status sets at once: ``orders`` and ``<name>_orders`` per dims.

    Also carries ``rows`` and any extra per-row ``sums`` up to the dims grain.
    """
    flags = {f"{n}_orders": status_flag(s) for n, s in status_sets.items()}
    per_order = order_level(df, dims, flags, sums)
    has_id = F.col("order_id").isNotNull()
    aggs = [F.count("order_id").alias("orders"), F.sum("_rows").alias("rows")]
    aggs += [F.coalesce(F.sum(F.when(has_id, F.col(n))), F.lit(0)).alias(n) for n in flags]
    aggs += [F.sum(n).alias(n) for n in (sums or {})]
    return per_order.groupBy(*dims).agg(*aggs)


def status_rate(n_col: str, d_col: str = "orders") -> Column:
    """A3: rate % rounded to 2 places (0 when there are no orders)."""
    return F.round(safe_pct(F.col(n_col), F.col(d_col)), 2)


def comparison_metrics(df: DataFrame, dims: list[str]) -> DataFrame:
    """A4: orders, revenue, units, AOV (= revenue ÷ orders) per dims."""
    out = df.groupBy(*dims).agg(
        F.countDistinct("order_id").alias("orders"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("_rev"),
        F.coalesce(F.sum("item_quantity"), F.lit(0)).cast("bigint").alias("units"))
    return out.select(*dims, "orders", money(F.col("_rev")).alias("revenue"), "units",
                      ratio(F.col("_rev"), F.col("orders")).alias("aov"))


def zip_rows(*one_row: DataFrame) -> DataFrame:
    """Combine single-row aggregates that have disjoint columns into one row.

    Union the rows (missing columns are null) and take ``max`` per column;
    no join of any kind.
    """
    u = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def share_of_total(value: str, partition: list[str] | None = None) -> Column:
    """Share (%) of a value in its partition total (over already aggregated rows)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*(partition or []))
    return safe_pct(F.col(value), F.sum(value).over(w))
