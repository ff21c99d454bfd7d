"""Chart data.

Time-series charts group by a calendar bucket whose grain comes from the
request (``filters.granularity``) or from the observed date span (one
min/max aggregate). SKU charts rank with ``orderBy(...).limit(n)`` and reuse
the bounded top-n frame through a broadcast semi join (J7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import growth_pct, money, ratio, safe_pct
from ..functions.timebuckets import (finish_series, grain_from_data, requested_grain, with_bucket)
from ..plans.history import fetch_two_windows
from ..plans.request import HistoryRequest, previous_window
from .core import status_order_counts, status_rate
from .kpis import CANCELLED, RTO

SKU = "canonical_sku_normalized"


def chart_grain(df: DataFrame, req: HistoryRequest) -> str | Column:
    return requested_grain((req.filters or {}).get("granularity")) or grain_from_data(df)


def _series(df: DataFrame, req: HistoryRequest, aggs: list) -> DataFrame:
    grain = chart_grain(df, req)
    out = with_bucket(df, grain).groupBy("_bucket").agg(*aggs)
    return finish_series(out, grain).withColumn("grain", F.lit(grain))


def orders_line(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """G1."""
    return _series(df, req, [F.countDistinct("order_id").alias("orders")])


def units_line(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """G2."""
    return _series(df, req, [F.sum("item_quantity").cast("bigint").alias("units")])


def revenue_line(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """G3."""
    return _series(df, req, [money(F.sum("total_amount")).alias("revenue")])


def orders_aov_line(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """Orders and revenue ÷ orders per bucket."""
    out = _series(df, req, [F.countDistinct("order_id").alias("orders"), F.sum("total_amount").alias("_rev")])
    return out.withColumn("aov", ratio(F.col("_rev"), F.col("orders"))).drop("_rev")


def payment_mix_area(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """COD rows and all other rows per bucket."""
    cod = F.upper(F.trim(F.col("payment_mode"))) == "COD"
    return _series(df, req, [F.count(F.when(cod, 1)).alias("cod"), F.count(F.when(~cod, 1)).alias("prepaid")])


def order_type_mix_area(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """B2B rows and B2C rows per bucket."""
    t = F.upper(F.trim(F.col("order_type")))
    return _series(df, req, [F.count(F.when(t == "B2B", 1)).alias("b2b"), F.count(F.when(t == "B2C", 1)).alias("b2c")])


def cancellation_return_rate_line(df: DataFrame, req: HistoryRequest) -> DataFrame:
    """Cancel and RTO rates (distinct orders) per bucket."""
    grain = chart_grain(df, req)
    per = status_order_counts(with_bucket(df, grain), ["_bucket"], {"c": CANCELLED, "r": RTO})
    out = per.select("_bucket", status_rate("c_orders").alias("cancellation_rate"),
                     status_rate("r_orders").alias("rto_rate"))
    return finish_series(out, grain).withColumn("grain", F.lit(grain))


def order_intensity_heatmap(df: DataFrame) -> DataFrame:
    """Distinct orders per weekday × hour on the dense 7 × 24 grid (zeros filled).

    The grid is generated from ``range(168)`` (a fixed 168-row frame), so the
    left join with the ≤168 aggregated cells never crosses anything.
    """
    spark: SparkSession = df.sparkSession
    cells = (df.where(F.col("order_date").isNotNull())
             .groupBy("day_of_week", "hour_of_day").agg(F.countDistinct("order_id").alias("order_count")))
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("day_index"),
                                   (F.col("id") % 24).cast("int").alias("hour"))
    day_names = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    out = grid.join(F.broadcast(cells), (grid.day_index == cells.day_of_week) & (grid.hour == cells.hour_of_day), "left")
    return out.select(F.element_at(day_names, F.col("day_index") + 1).alias("day_of_week"), "day_index", "hour",
                      F.coalesce(F.col("order_count"), F.lit(0)).alias("order_count"))


def _top(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(n)


def top_skus_units(df: DataFrame, n: int = 10) -> DataFrame:
    """Top-n canonical SKUs by units."""
    per = df.groupBy(SKU).agg(F.sum("item_quantity").alias("units"))
    return _top(per, SKU, "units", n).select(F.col(SKU).alias("canonical_sku"), F.col("units").cast("double"))


def top_skus_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    """Top-n canonical SKUs by revenue."""
    per = df.groupBy(SKU).agg(F.sum("total_amount").alias("revenue"))
    return _top(per, SKU, "revenue", n).select(F.col(SKU).alias("canonical_sku"), money(F.col("revenue")).alias("revenue"))


def sku_revenue_vs_cancellation(df: DataFrame, n: int = 50) -> DataFrame:
    """Per SKU revenue (x), cancel rate over distinct orders (y), units (r); top n by revenue."""
    per = status_order_counts(df, [SKU], {"c": CANCELLED},
                              sums={"rev": F.col("total_amount"), "units": F.col("item_quantity")})
    return _top(per, SKU, "rev", n).select(
        F.col(SKU).alias("canonical_sku"), money(F.col("rev")).alias("x_revenue"),
        status_rate("c_orders").alias("y_cancellation_rate"), F.col("units").cast("double").alias("r_units"))


def _top_bases(df: DataFrame, n: int) -> DataFrame:
    """One row per top-n base SKU, from one scan: (base_sku, _u, y_index, _cells, _sizes).

    ``_cells`` holds the base's (size, units); ``_sizes`` the sorted sizes of all
    n bases. A base has as many cells as it has sizes, and the windows run over n rows.
    """
    cells = df.groupBy("base_sku", "size_bucket").agg(F.sum("item_quantity").alias("units"))
    per = cells.groupBy("base_sku").agg(F.sum("units").alias("_u"), F.collect_list(F.struct("size_bucket", "units")).alias("_cells"))
    rank = Window.orderBy(F.col("_u").desc(), F.col("base_sku"))
    sizes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cells.size_bucket").over(Window.partitionBy()))))
    return _top(per, "base_sku", "_u", n).withColumns({"y_index": F.row_number().over(rank) - 1, "_sizes": sizes})


def base_sku_size_heatmap(df: DataFrame, n: int = 10) -> DataFrame:
    """Units per (base SKU, size) for the top-n base SKUs (present cells)."""
    cells = _top_bases(df, n).select("base_sku", "y_index", "_sizes", F.inline("_cells"))
    return cells.select("base_sku", F.col("size_bucket").alias("size"),
                        (F.array_position("_sizes", F.col("size_bucket")) - 1).cast("int").alias("x_index"),
                        F.col("y_index").cast("int").alias("y_index"), F.col("units").cast("double"))


def top_base_sku_size_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """The dense grid of top-n base SKUs (by rank ``y_index``) and the sizes that these have (by name,
    ``x_index``): units, 0 where a base lacks the size, and the share of the base."""
    grid = _top_bases(df, n).select("base_sku", "y_index", "_u", "_cells", F.posexplode("_sizes").alias("x_index", "size"))
    there = F.filter("_cells", lambda c: c["size_bucket"] == F.col("size"))
    units = F.coalesce(F.get(there, F.lit(0))["units"], F.lit(0))
    return grid.select("base_sku", F.col("y_index").cast("int").alias("y_index"), "size", "x_index",
                       units.cast("double").alias("units"), F.round(safe_pct(units, F.col("_u")), 2).alias("share_pct"))


def top_sku_weekly_velocity(df: DataFrame) -> DataFrame:
    """Weekly units of the single top SKU by units."""
    per = df.groupBy(SKU).agg(F.sum("item_quantity").alias("_u"))
    top1 = _top(per, SKU, "_u", 1).select(SKU)
    rows = df.join(F.broadcast(top1), SKU, "left_semi")
    out = with_bucket(rows, "weekly").groupBy(SKU, "_bucket").agg(F.sum("item_quantity").cast("double").alias("units"))
    return finish_series(out, "weekly").withColumnRenamed(SKU, "top_sku")


def sku_revenue_change_waterfall(history: DataFrame, req: HistoryRequest, n: int = 20) -> DataFrame:
    """Per-SKU revenue delta vs the previous window; contribution to the total change; top n by |delta|."""
    cs, ce, ps, pe, _ = previous_window(req)
    tagged = fetch_two_windows(history, req, (cs, ce), (ps, pe))
    per = tagged.groupBy(SKU).agg(
        F.coalesce(F.sum(F.when(F.col("window") == "current", F.col("total_amount"))), F.lit(0)).alias("cur"),
        F.coalesce(F.sum(F.when(F.col("window") == "previous", F.col("total_amount"))), F.lit(0)).alias("prev"))
    per = per.withColumn("delta", F.col("cur") - F.col("prev"))
    total_change = per.agg(F.sum("delta")).scalar()
    top = per.orderBy(F.abs(F.col("delta")).desc(), F.col(SKU).asc()).limit(n)
    return top.select(
        F.col(SKU).alias("canonical_sku"), money(F.col("cur")).alias("current_revenue"),
        money(F.col("prev")).alias("previous_revenue"), money(F.col("delta")).alias("delta_revenue"),
        F.round(safe_pct(F.col("delta"), total_change), 2).alias("contribution_pct"),
        money(total_change).alias("total_change"))
