"""Posted-orders analytics over nested order documents.

Two grains, explicit: ``posted_order_rows`` (one row per order document) and
``posted_lines`` (one row per suborder, via ``explode``). Money arrives as
text and is coerced with ``try_cast`` (bad → 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import bucket_label, money, ratio, safe_pct, to_number, to_timestamp_lenient
from ..functions.filters import state_equals, status_mentions
from ..functions.timebuckets import POSTED_THRESHOLDS, bucket_start, grain_from_data
from ..schema import MONEY
from .core import zip_rows


def flatten_orders(docs: DataFrame) -> DataFrame:
    """One row per suborder with ``suborder_``-prefixed fields; orders without suborders kept. A field that the order
    has under a suborder's name holds where the suborder has none."""
    order_cols = [c for c in docs.columns if c != "suborders"]
    subs = docs.schema["suborders"].dataType.elementType.fields
    x = docs.select(*order_cols, F.explode_outer("suborders").alias("s"))
    own = lambda f: [F.col(f"suborder_{f.name}").try_cast(f.dataType)] if f"suborder_{f.name}" in order_cols else []
    flat = [F.coalesce(F.col("s")[f.name], *own(f)).alias(f"suborder_{f.name}") for f in subs]
    names = {f"suborder_{f.name}" for f in subs}
    return x.select(*(c for c in order_cols if c not in names), *flat)


def posted_order_rows(docs: DataFrame) -> DataFrame:
    """Order grain with coerced dates and numbers."""
    return docs.withColumns({
        "order_date": to_timestamp_lenient("order_date"),
        "total_amount": to_number("total_amount", MONEY),
        "total_tax": to_number("total_tax", MONEY),
        "total_shipping_charge": to_number("total_shipping_charge", MONEY),
        "order_quantity": F.coalesce(F.col("order_quantity"), F.lit(0)),
    })


def posted_lines(docs: DataFrame) -> DataFrame:
    """Suborders flattened to a fixed line schema; numbers default to 0."""
    x = docs.select(to_timestamp_lenient("order_date").alias("order_date"), "order_id", "state",
                    F.explode("suborders").alias("s"))
    return x.select(
        "order_id", "order_date", "state", F.col("s.sku").alias("sku"), F.col("s.productName").alias("productName"),
        to_number(F.col("s.selling_price")).alias("selling_price"), to_number(F.col("s.cost")).alias("cost"),
        to_number(F.col("s.mrp")).alias("mrp"),
        *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in ("item_quantity", "cancelled_quantity", "shipped_quantity")],
        to_timestamp_lenient(F.col("s.suborder_history.inventory_assigned_datetime")).alias("inventory_assigned"),
        to_timestamp_lenient(F.col("s.suborder_history.qc_pass_datetime")).alias("qc_pass"))


def item_rows(docs: DataFrame) -> DataFrame:
    """``suborders[].items[]`` rows; when the input holds no items at all, one row per
    order with 1/0 flags from status text ('cancel' / 'return' in order or shipping status)."""
    orders = docs.withColumn("order_date", to_timestamp_lenient("order_date"))
    items = (orders.select("order_date", F.explode("suborders").alias("s"))
             .select("order_date", F.explode("s.items").alias("i"))
             .select("order_date", F.coalesce("i.cancelled_quantity", F.lit(0)).alias("cancelled_quantity"),
                     F.coalesce("i.returned_quantity", F.lit(0)).alias("returned_quantity")))
    n_items = items.agg(F.count(F.lit(1))).scalar()
    fallback = orders.where(n_items == 0).select(
        "order_date", F.when(status_mentions("cancel"), 1).otherwise(0).cast("bigint").alias("cancelled_quantity"),
        F.when(status_mentions("return"), 1).otherwise(0).cast("bigint").alias("returned_quantity"))
    return items.unionByName(fallback)


def volume(docs: DataFrame) -> DataFrame:
    """Orders, shipped units, net units (items − cancelled), distinct SKUs."""
    o = docs.agg(F.count(F.lit(1)).alias("total_orders"))
    lines = posted_lines(docs).agg(
        F.coalesce(F.sum("shipped_quantity"), F.lit(0)).cast("bigint").alias("total_skus_sold"),
        (F.coalesce(F.sum("item_quantity"), F.lit(0)) - F.coalesce(F.sum("cancelled_quantity"), F.lit(0)))
        .cast("bigint").alias("net_skus_sold"),
        F.countDistinct("sku").alias("unique_skus_ordered"))
    return zip_rows(o, lines).select("total_orders", F.coalesce("total_skus_sold", F.lit(0)).alias("total_skus_sold"),
                                     F.coalesce("net_skus_sold", F.lit(0)).alias("net_skus_sold"),
                                     F.coalesce("unique_skus_ordered", F.lit(0)).alias("unique_skus_ordered"))


def revenue(docs: DataFrame) -> DataFrame:
    """Gross revenue, margin (revenue − Σcost, 0 unless Σcost > 0; Q20), AOV, mean selling price."""
    o = posted_order_rows(docs).agg(F.sum("total_amount").alias("_rev"), F.count(F.lit(1)).alias("_orders"))
    lines = posted_lines(docs).agg(F.sum("cost").alias("_cost"), F.sum("selling_price").alias("_sp"),
                                   F.count(F.lit(1)).alias("_lines"))
    row = zip_rows(o, lines)
    rev, cost = F.coalesce(F.col("_rev"), F.lit(0)), F.coalesce(F.col("_cost"), F.lit(0))
    return row.select(money(rev).alias("gross_revenue"),
                      money(F.when(cost > 0, rev - cost).otherwise(F.lit(0))).alias("gross_margin"),
                      ratio(rev, F.col("_orders")).alias("aov"), ratio(F.col("_sp"), F.col("_lines")).alias("asp"))


def payment(docs: DataFrame) -> DataFrame:
    """COD vs other (non-null) payment modes, counts and % of orders."""
    pm = F.col("payment_mode")
    row = docs.agg(F.count(F.when(pm == "COD", 1)).alias("cod_orders"),
                   F.count(F.when(pm.isNotNull() & (pm != "COD"), 1)).alias("prepaid_orders"),
                   F.count(F.lit(1)).alias("_n"))
    return row.select("cod_orders", "prepaid_orders",
                      F.round(safe_pct(F.col("cod_orders"), F.col("_n")), 2).alias("cod_percentage"),
                      F.round(safe_pct(F.col("prepaid_orders"), F.col("_n")), 2).alias("prepaid_percentage"))


def payment_breakdown(docs: DataFrame) -> DataFrame:
    """N3 (breakdown): orders per raw payment mode (nulls dropped)."""
    return docs.where(F.col("payment_mode").isNotNull()).groupBy("payment_mode").agg(F.count(F.lit(1)).alias("orders"))


def cancellation(docs: DataFrame) -> DataFrame:
    """Cancelled and returned order rates; the state with most returned orders (ties by name)."""
    st = F.lower(F.trim(F.col("order_status")))
    returned = docs.where(st == "returned").where(F.col("state").isNotNull())
    top_state = (returned.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(F.col("n").desc(), F.col("state").asc()).limit(1).select("state").scalar())
    row = docs.agg(F.count(F.when(st == "cancelled", 1)).alias("cancelled_orders"),
                   F.count(F.when(st == "returned", 1)).alias("rto_orders"), F.count(F.lit(1)).alias("_n"))
    return row.select(F.round(safe_pct(F.col("rto_orders"), F.col("_n")), 2).alias("rto_rate"),
                      F.round(safe_pct(F.col("cancelled_orders"), F.col("_n")), 2).alias("cancellation_rate"),
                      "cancelled_orders", "rto_orders", top_state.alias("highest_state_rto"))


def day_frequency(docs: DataFrame) -> DataFrame:
    """Orders per day and the mean of the last 7 days present (min 1)."""
    per = (posted_order_rows(docs).where(F.col("order_date").isNotNull())
           .groupBy(F.to_date("order_date").alias("day")).agg(F.count(F.lit(1)).alias("orders")))
    w = Window.orderBy("day").rowsBetween(-6, 0)   # over ≤ one row per calendar day, not raw rows
    return per.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "orders",
                      F.round(F.avg("orders").over(w), 4).alias("moving_average_7d"))


def processing_times(docs: DataFrame) -> DataFrame:
    """Mean hours order → inventory assigned, assigned → QC pass, and their sum."""
    lines = posted_lines(docs)
    inv = F.expr("timestampdiff(SECOND, order_date, inventory_assigned)") / 3600.0
    qc = F.expr("timestampdiff(SECOND, inventory_assigned, qc_pass)") / 3600.0
    row = lines.agg(F.avg(inv).alias("i"), F.avg(qc).alias("q"))
    i, q = F.coalesce(F.col("i"), F.lit(0.0)), F.coalesce(F.col("q"), F.lit(0.0))
    return row.select(F.round(i, 4).alias("avg_inventory_assignment_time_hours"), F.round(q, 4).alias("avg_qc_time_hours"),
                      F.round(i + q, 4).alias("avg_order_processing_time_hours"))


def by_state(docs: DataFrame) -> DataFrame:
    """Orders, revenue and cancelled-order % per state."""
    o = posted_order_rows(docs).where(F.col("state").isNotNull())
    st = F.lower(F.trim(F.col("order_status")))
    return o.groupBy("state").agg(
        F.count(F.lit(1)).alias("order_count"), money(F.sum("total_amount")).alias("revenue"),
        F.round(safe_pct(F.count(F.when(st == "cancelled", 1)), F.count(F.lit(1))), 2).alias("cancellation_pct"))


def top_products(docs: DataFrame, n: int = 10) -> DataFrame:
    """Top-n SKUs by quantity, by revenue (price × quantity), products by quantity (long form)."""
    lines = posted_lines(docs)
    q = F.col("item_quantity")
    per = lines.groupingSets([["sku"], ["productName"]], "sku", "productName").agg(   # one pass over the documents
        F.sum(q).alias("_q"), F.sum(F.col("selling_price") * q).alias("_r"), F.grouping("sku").alias("_by_product"))
    row = lambda name, key, val: F.struct(
        F.lit(name).alias("list"), F.col(key).alias("key"), F.col(val).cast(per.schema["_r"].dataType).alias("_v"))
    lists = per.select(F.inline(F.when(F.col("_by_product") == 1, F.array(row("top_products_by_quantity", "productName", "_q")))
                                .otherwise(F.array(row("top_skus_by_quantity", "sku", "_q"),
                                                   row("top_skus_by_revenue", "sku", "_r")))))
    # the rank limit is applied in every task before the shuffle
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.col("_v").desc(), F.col("key").asc()))
    top = lists.where(F.col("key").isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= n)
    return top.select("list", "key", F.round(F.col("_v"), 2).cast("double").alias("value"))


def _posted_grain(dates: DataFrame) -> Column:
    """The grain of the observed span, inside the plan."""
    return grain_from_data(dates, "order_date", POSTED_THRESHOLDS)


def _label(bucket: Column, grain: Column) -> Column:
    return F.when(grain == "daily", F.date_format(bucket, "EEE")).otherwise(bucket_label(bucket, grain))


def _series(rows: DataFrame, grain: Column, *aggs: Column) -> DataFrame:
    """Buckets and their total from one ROLLUP over rows with ``_b``: the total's ``_b`` is null, ``is_total`` true."""
    return rows.rollup("_b").agg(*aggs, (F.grouping("_b") == 1).alias("is_total")).withColumn("_grain", grain)


def _finish(agg: DataFrame) -> DataFrame:
    label = F.when(F.col("is_total"), F.lit("total")).otherwise(_label(F.col("_b"), F.col("_grain")))
    return agg.select(F.date_format("_b", "yyyy-MM-dd").alias("bucket"), label.alias("label"), F.col("_grain").alias("grain"),
                      *[c for c in agg.columns if c not in ("_b", "_grain")]).orderBy("is_total", "bucket")


def _dated(docs: DataFrame, *cols: Column | str) -> DataFrame:
    return docs.select(to_timestamp_lenient("order_date").alias("order_date"), *cols).where(F.col("order_date").isNotNull())


def volume_chart(docs: DataFrame) -> DataFrame:
    """Orders and distinct SKUs per bucket (≤7 days daily, ≤90 weekly, else monthly) and in total.

    One pass over the documents: a row per suborder's SKU, its order counted at the first. SKUs are combined per
    bucket before the rollup, whose distinct counts are exact for the total, too.
    """
    grain = _posted_grain(_dated(docs))
    rows = _dated(docs, F.posexplode_outer(F.transform("suborders", lambda s: s["sku"])).alias("pos", "sku"))
    per = (rows.groupBy(bucket_start(grain).alias("_b"), "sku")
           .agg(F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("n")))
    return _finish(_series(per, grain, F.sum("n").alias("order_count"),
                           F.countDistinct(F.when(F.col("sku") != "", F.col("sku"))).alias("unique_sku_count")))


def revenue_chart(docs: DataFrame) -> DataFrame:
    """Revenue, orders and AOV per bucket and in total."""
    o = _dated(docs, to_number("total_amount", MONEY).alias("total_amount"))
    grain = _posted_grain(o)
    agg = _series(o.withColumn("_b", bucket_start(grain)), grain, F.sum("total_amount").alias("_rev"),
                  F.count(F.lit(1)).alias("orders"))
    return _finish(agg.select("_b", money(F.col("_rev")).alias("revenue"), "orders",
                              ratio(F.col("_rev"), F.col("orders")).alias("aov"), "is_total", "_grain"))


def payment_chart(docs: DataFrame) -> DataFrame:
    """COD and other (non-null) payment-mode orders per bucket and in total."""
    o = _dated(docs, "payment_mode")
    grain, pm = _posted_grain(o), F.col("payment_mode")
    return _finish(_series(
        o.withColumn("_b", bucket_start(grain)), grain, F.count(F.when(pm == "COD", 1)).alias("cod"),
        F.count(F.when(pm.isNotNull() & (pm != "COD"), 1)).alias("prepaid")))


def cancellation_chart(docs: DataFrame) -> DataFrame:
    """Cancelled and returned quantities per bucket and in total, from item rows."""
    items = item_rows(docs).where(F.col("order_date").isNotNull())
    grain = _posted_grain(items)
    return _finish(_series(
        items.withColumn("_b", bucket_start(grain)), grain, F.sum("cancelled_quantity").cast("bigint").alias("cancelled"),
        F.sum("returned_quantity").cast("bigint").alias("returned")))


def pincodes_in_state(docs: DataFrame, state: str) -> DataFrame:
    """Orders per pincode within one state (case-insensitive), most orders first, and the state's total."""
    per = docs.where(state_equals(state)).rollup("pin_code").agg(
        F.count(F.lit(1)).alias("order_count"), (F.grouping("pin_code") == 1).alias("is_total"))
    return (per.select(F.col("pin_code").cast("string").alias("pin_code"), "order_count", "is_total")
            .orderBy("is_total", F.col("order_count").desc(), "pin_code"))
