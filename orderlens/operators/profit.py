"""Profit metrics over the vendor cost sheet (V1–V6).

Columns: ``mrp`` (selling price) and ``final_price`` (cost). Non-numeric
values count as 0, as in the source definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))


def _row_margin(mrp: Column, cost: Column) -> Column:
    """(MRP − cost) / MRP × 100, 0 when MRP is 0."""
    return F.when(mrp != 0, (mrp - cost) / mrp * 100.0).otherwise(0.0)


def _row_markup(mrp: Column, cost: Column) -> Column:
    """(MRP − cost) / cost, 0 when cost is 0."""
    return F.when(cost != 0, (mrp - cost) / cost).otherwise(0.0)


def profit_totals(sheet: DataFrame, mrp: str = "mrp", cost: str = "final_price") -> DataFrame:
    """V1–V5 in one pass: sum of row margins %, gross profit, sum of markups, sums of prices, cost ÷ price %."""
    m, c = _n(mrp), _n(cost)
    row = sheet.agg(
        F.round(F.sum(_row_margin(m, c)), 2).alias("margin_sum_pct"),
        F.round(F.sum(m - c), 2).alias("gross_profit"),
        F.round(F.sum(_row_markup(m, c)), 4).alias("markup_sum"),
        F.round(F.coalesce(F.sum(m), F.lit(0.0)), 2).alias("selling_price"),
        F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias("cost_price"))
    return row.withColumn("cost_to_price_ratio",
                          F.round(F.try_divide(F.col("cost_price"), F.col("selling_price")) * 100.0, 2))


def profit_items(sheet: DataFrame, mrp: str = "mrp", cost: str = "final_price",
                 keep: tuple[str, ...] = ("style_name", "collection_name", "brand")) -> DataFrame:
    """V6 (items): per-item cost, price, gross profit, margin %, markup, markup % and cost ÷ price %."""
    m, c = _n(mrp), _n(cost)
    sp, cp = F.round(m, 2), F.round(c, 2)
    markup = F.round(_row_markup(m, c), 4)
    return sheet.select(
        *[F.col(k) for k in keep if k in sheet.columns],
        cp.alias("cost_price"), sp.alias("selling_price"), F.round(m - c, 2).alias("gross_profit"),
        F.round(_row_margin(m, c), 2).alias("gross_margin"), markup.alias("markup"),
        F.round(markup * 100.0, 2).alias("markup_percent"),
        F.round(F.try_divide(cp, sp) * 100.0, 2).alias("cost_to_price_ratio"))


def profit_summary(items: DataFrame, group_col: str) -> DataFrame:
    """V6 (summary): per group item count, average margin %, average markup % and total gross profit."""
    return items.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.coalesce(F.avg("gross_margin"), F.lit(0.0)), 2).alias("avg_gross_margin"),
        F.round(F.coalesce(F.avg("markup_percent"), F.lit(0.0)), 2).alias("avg_markup_percent"),
        F.round(F.sum("gross_profit"), 2).alias("total_gross_profit"))
