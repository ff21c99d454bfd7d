"""Per-SKU metric profiles, computed for all SKUs at once, and their incremental job.

The source system loops over SKUs and rewrites one JSON document each; here
every breakdown is a long-form table keyed by ``canonical_sku`` computed in
grouped passes, and the incremental job merges new daily rows into the stored
daily table (newest wins per key) and derives cumulative and rolling values
from the merged daily table (Q16–Q18).

Row money: revenue = selling price × quantity, cogs = cost × quantity,
total MRP = MRP × quantity (U — C23).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import parse_raw_sku, to_number

KEY = "canonical_sku"


def prepare(lines: DataFrame, sku_col: str = "raw_sku") -> DataFrame:
    """C21 + C23: parse the raw SKU into (canonical SKU, size) and add row money columns."""
    return with_money(keyed(lines, sku_col))


def keyed(lines: DataFrame, sku_col: str = "raw_sku") -> DataFrame:
    """The lines' columns that profiles need, with the raw SKU parsed: what a shuffle by SKU moves."""
    base, size = parse_raw_sku(sku_col)
    return lines.select(
        base.alias(KEY), size.alias("parsed_size"), "order_id", "order_date", F.to_date("order_date").alias("day"),
        "order_status", "payment_mode", "marketplace", "state", "courier", "import_warehouse_name",
        to_number("item_quantity", "decimal(18,4)").alias("qty"), to_number("selling_price").alias("sp"),
        to_number("cost").alias("cp"), to_number("mrp").alias("unit_mrp"))


def with_money(rows: DataFrame) -> DataFrame:
    """The row money columns."""
    return rows.select("*", (F.col("sp") * F.col("qty")).alias("revenue"), (F.col("cp") * F.col("qty")).alias("cogs"),
                       (F.col("unit_mrp") * F.col("qty")).alias("total_mrp"))


def dealt(p: DataFrame) -> DataFrame:
    """Prepared rows dealt by SKU and order, before anything counts them.

    A SKU's groups (days, marketplaces, orders) are about as many as its rows, so partial aggregates in the tasks that
    read the table combine little and hold whole file splits. Dealt, a task holds its share, and distinct orders are
    found where they lie; a hot SKU is spread by its orders.
    """
    return p.repartition(KEY, "order_id")


def _pct(n: Column, d: Column, scale: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d.cast("double")) * 100.0, F.lit(0.0)), scale)


def _r(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def cumulative(p: DataFrame) -> DataFrame:
    """Revenue, units, distinct orders, AOV, COGS and gross margin % per SKU."""
    g = p.groupBy(KEY).agg(F.sum("revenue").alias("rev"), F.sum("qty").alias("units"),
                           F.countDistinct("order_id").alias("total_orders"), F.sum("cogs").alias("cogs"))
    return g.select(KEY, _r(F.col("rev")).alias("total_revenue"), _r(F.col("units")).alias("total_units_sold"),
                    "total_orders", F.round(F.coalesce(F.try_divide(F.col("rev").cast("double"),
                                                                    F.col("total_orders").cast("double")), F.lit(0.0)), 2)
                    .alias("avg_order_value"),
                    _r(F.col("cogs")).alias("total_cogs"), _pct(F.col("rev") - F.col("cogs"), F.col("rev")).alias("gross_margin_pct"))


def status_breakdown(p: DataFrame) -> DataFrame:
    """Distinct orders per lower-cased status; cancel / return rates over the sum of those counts."""
    per = p.groupBy(KEY, F.lower(F.col("order_status")).alias("status")).agg(F.countDistinct("order_id").alias("orders"))
    tot = F.greatest(F.sum("orders").over(Window.partitionBy(KEY)), F.lit(1))
    canc = F.sum(F.when(F.col("status") == "cancelled", F.col("orders")).otherwise(0)).over(Window.partitionBy(KEY))
    ret = F.sum(F.when(F.col("status") == "returned", F.col("orders")).otherwise(0)).over(Window.partitionBy(KEY))
    return per.select(KEY, "status", "orders", _pct(canc, tot).alias("cancellation_rate"), _pct(ret, tot).alias("return_rate"))


def payment_split(p: DataFrame) -> DataFrame:
    """Distinct orders and revenue per payment mode."""
    return p.groupBy(KEY, "payment_mode").agg(F.countDistinct("order_id").alias("orders"), _r(F.sum("revenue")).alias("revenue"))


def by_marketplace(p: DataFrame) -> DataFrame:
    """U4: per marketplace revenue, units, orders, unweighted mean prices, margin %, MRP discount %, revenue share %."""
    g = p.groupBy(KEY, "marketplace").agg(
        F.sum("revenue").alias("rev"), F.sum("qty").alias("units"), F.countDistinct("order_id").alias("order_count"),
        F.avg(F.col("sp").cast("double")).alias("avg_sp"), F.avg(F.col("unit_mrp").cast("double")).alias("avg_mrp"),
        F.avg(F.col("cp").cast("double")).alias("avg_cost"), F.sum("cogs").alias("cogs"))
    total = F.sum("rev").over(Window.partitionBy(KEY))
    return g.select(
        KEY, "marketplace", _r(F.col("rev")).alias("revenue"), _r(F.col("units")).alias("units_sold"), "order_count",
        F.round("avg_sp", 2).alias("avg_selling_price"), F.round("avg_mrp", 2).alias("avg_mrp"),
        F.round("avg_cost", 2).alias("avg_cost"), _pct(F.col("rev") - F.col("cogs"), F.col("rev")).alias("gross_margin_pct"),
        F.round(F.coalesce(F.try_divide(F.col("avg_mrp") - F.col("avg_sp"), F.col("avg_mrp")) * 100.0, F.lit(0.0)), 2)
        .alias("mrp_discount_pct"),
        _pct(F.col("rev"), total).alias("revenue_share_pct"))


def _unit_prices(g: DataFrame) -> list[Column]:
    u = F.col("units").cast("double")
    avg_sp = F.coalesce(F.try_divide(F.col("rev").cast("double"), u), F.lit(0.0))
    avg_cp = F.coalesce(F.try_divide(F.col("cogs").cast("double"), u), F.lit(0.0))
    avg_mrp = F.coalesce(F.try_divide(F.col("tmrp").cast("double"), u), F.lit(0.0))
    return [F.round(avg_sp, 2).alias("avg_sp"), F.round(avg_cp, 2).alias("avg_cp"), F.round(avg_mrp, 2).alias("avg_mrp"),
            _pct(F.col("rev") - F.col("cogs"), F.col("rev")).alias("gross_margin_pct"),
            F.round(F.coalesce(F.try_divide(avg_mrp - avg_sp, avg_mrp) * 100.0, F.lit(0.0)), 2).alias("mrp_discount_pct")]


def price_history(p: DataFrame) -> DataFrame:
    """Unit-weighted prices per (day, marketplace) — by calendar day (Q17)."""
    g = p.groupBy(KEY, "day", "marketplace").agg(F.sum("revenue").alias("rev"), F.sum("cogs").alias("cogs"),
                                                 F.sum("total_mrp").alias("tmrp"), F.sum("qty").alias("units"))
    return g.select(KEY, F.date_format("day", "yyyy-MM-dd").alias("date"), "marketplace", *_unit_prices(g))


def by_state(p: DataFrame, top: int = 5) -> DataFrame:
    """Revenue and units per state, with the state's revenue rank (top states: rank ≤ 5)."""
    g = p.groupBy(KEY, "state").agg(_r(F.sum("revenue")).alias("revenue"), _r(F.sum("qty")).alias("units_sold"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("revenue").desc(), F.col("state").asc()))
    return g.withColumn("revenue_rank", rank).withColumn("is_top_state", F.col("revenue_rank") <= top)


def by_size(p: DataFrame) -> DataFrame:
    """Units, revenue and revenue share per parsed size."""
    g = p.groupBy(KEY, F.col("parsed_size").alias("size")).agg(F.sum("qty").alias("units"), F.sum("revenue").alias("rev"))
    return g.select(KEY, "size", _r(F.col("units")).alias("units_sold"), _r(F.col("rev")).alias("revenue"),
                    _pct(F.col("rev"), F.sum("rev").over(Window.partitionBy(KEY))).alias("revenue_share_pct"))


def fulfilment_distribution(p: DataFrame) -> DataFrame:
    """U8: distinct orders per courier and units per warehouse (long form)."""
    c = p.groupBy(KEY, F.col("courier").alias("key")).agg(F.countDistinct("order_id").cast("double").alias("value"))
    w = p.groupBy(KEY, F.col("import_warehouse_name").alias("key")).agg(_r(F.sum("qty")).alias("value"))
    return (c.select(KEY, F.lit("courier_orders").alias("distribution"), "key", "value")
            .unionByName(w.select(KEY, F.lit("warehouse_units").alias("distribution"), "key", "value")))


def daily_series(p: DataFrame) -> DataFrame:
    """Per (SKU, calendar day) revenue, units, orders, profit, COGS, total MRP and unit prices."""
    g = p.groupBy(KEY, "day").agg(F.sum("revenue").alias("rev"), F.sum("qty").alias("units"),
                                  F.countDistinct("order_id").alias("orders"), F.sum("cogs").alias("cogs"),
                                  F.sum("total_mrp").alias("tmrp"))
    return g.select(KEY, "day", _r(F.col("rev")).alias("revenue"), _r(F.col("units")).alias("units_sold"),
                    F.col("orders").cast("bigint").alias("orders"), _r(F.col("rev") - F.col("cogs")).alias("gross_profit"),
                    _r(F.col("cogs")).alias("cogs"), _r(F.col("tmrp")).alias("total_mrp"), *_unit_prices(g))


def rolling(daily: DataFrame) -> DataFrame:
    """Last 7 / 30 *days with sales* (rows, parity) and last 7 / 30 *calendar* days, at each SKU's last day.

    Windows are partitioned by SKU over the daily table (one row per SKU-day),
    so the largest partition is bounded by the number of days, not by rows.
    """
    w_rows = Window.partitionBy(KEY).orderBy("day")
    day_no = F.datediff(F.col("day"), F.lit("1970-01-01"))
    w_cal = Window.partitionBy(KEY).orderBy(day_no)
    cols = {}
    for n in (7, 30):
        for kind, w in (("rows", w_rows.rowsBetween(-(n - 1), 0)), ("days", w_cal.rangeBetween(-(n - 1), 0))):
            rev = F.sum("revenue").over(w)
            cols[f"r{n}{kind}_revenue"] = F.round(rev, 2)
            cols[f"r{n}{kind}_units_sold"] = F.round(F.sum("units_sold").over(w), 2)
            cols[f"r{n}{kind}_orders"] = F.sum("orders").over(w)
            cols[f"r{n}{kind}_gross_margin_pct"] = _pct(F.sum("gross_profit").over(w), rev)
    last = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("day").desc()))
    out = daily.withColumns(cols).withColumn("_last", last).where(F.col("_last") == 1).drop("_last")
    return out.select(KEY, F.date_format("day", "yyyy-MM-dd").alias("last_day"), *cols.keys())


def merge_latest(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union stored and new rows; per key the new row wins. One aggregation, no join."""
    cols = [c for c in stored.columns if c not in keys]
    tagged = (stored.select(*keys, F.struct(*cols).alias("_v"), F.lit(0).alias("_prio"))
              .unionByName(new.select(*keys, F.struct(*cols).alias("_v"), F.lit(1).alias("_prio"))))
    merged = tagged.groupBy(*keys).agg(F.max_by("_v", "_prio").alias("_v"))
    return merged.select(*keys, "_v.*")


EXPORT_SCHEMA = ("total_revenue double, total_units_sold double, total_orders bigint, avg_order_value double, total_cogs double, "
                 "gross_margin_pct double, daily_series array<struct<order_date:string,revenue:double,units_sold:double,orders:bigint>>")


def profile_export(daily: DataFrame, cumulative_tbl: DataFrame) -> DataFrame:
    """S13 export: one JSON document per SKU (cumulative values + its daily series)."""
    series = daily.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("order_date"), "revenue", "units_sold", "orders"))).alias("daily_series"))
    return cumulative_tbl.join(series, KEY, "left").select(
        KEY, F.to_json(F.struct(*[c for c in cumulative_tbl.columns if c != KEY], "daily_series")).alias("profile"))
