"""Batch bundle of all metric categories from one pass over the orders.

Every category reads the *cells*: one row per dimension value (month, SKU,
state, marketplace, …, and the whole table) with its distinct orders, rows and
sums. ``bundle_cells`` makes them in one scan and writes them, so the bundle
scans the history once for its cells and twice for the exact median:

1. the needed columns are dealt by order, the only shuffle of rows;
2. each row names its cells (``inline``), which are aggregated per order where
   they lie, then by cell with partial sums before the small second shuffle.

Output is long form ``(category, metric, key, value)`` — every part emits exactly
these four columns in this order, so parts are combined with positional ``union``
(no by-name re-resolution of the growing plan). Definitions that differ from the
single-metric endpoints are the bundle's own (row-based fulfilment / issue rates,
raw-size row counts, …).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import label_or_unknown, money, ratio, safe_pct
from ..functions.quantiles import exact_quantile
from ..functions.timebuckets import growth_series
from ..session import scratch_path
from . import kpis, metrics
from .core import status_flag, status_rate

BUNDLE_FULFILLED = ["Shipped", "Returned"]      # B5: DELIVERED and RETURNED members
BUNDLE_ISSUES = ["Cancelled", "Returned"]       # B11: CANCELLED and RETURNED members
BUNDLE_RISK = ["Cancelled", "RTO"]              # B12: union of both statuses

# status sets counted over distinct orders / over rows
_ORDER_SETS = {"cancelled": kpis.CANCELLED, "rto": kpis.RTO, "delivered": kpis.DELIVERED_LITERAL, "risk": BUNDLE_RISK}
_ROW_SETS = {"fulfilled": BUNDLE_FULFILLED, "issues": BUNDLE_ISSUES}
_SKU_DIMS = ("sku", "odd_sku", "style")

#: the cells that each category reads
DIMS = {"primary": ("all", "month", "sku", "odd_sku"), "product": ("all", "size", *_SKU_DIMS), "performance": ("all",),
        "geographic": ("state",), "channel": ("marketplace", "courier", "warehouse", "payment_mode", "order_type"),
        "quality": ("all", "marketplace"), "advanced": ("marketplace", "month")}


def _cell_keys() -> dict[str, tuple[Column, Column]]:
    """Dimension → (key, second key) of a row; a row with a null key is in no cell of that dimension."""
    none = F.lit(None).cast("string")
    label = label_or_unknown("sku")
    return {
        "all": (F.lit(""), none),
        "month": (F.date_format("order_date", "yyyy-MM"), none),
        "sku": (label, none),
        "odd_sku": (F.when(F.col("sku") != label, F.col("sku")), none),     # spellings that the label changes
        "style": (F.when(F.col("suborder_model_no").isNotNull(), label), F.col("suborder_model_no")),
        "size": (F.col("size"), none),
        "state": (label_or_unknown("state"), none),
        "marketplace": (label_or_unknown("marketplace"), none),
        "courier": (label_or_unknown("courier"), none),
        "warehouse": (label_or_unknown("import_warehouse_name"), none),
        "payment_mode": (F.col("payment_mode"), none),
        "order_type": (F.col("order_type"), none),
    }


def cells_of(df: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dim, key, sub, orders, rows, sums, …) from one scan of the fetched rows.

    Rows without an order id stay with the task that read them (they count as
    rows, never as orders), so they don't meet in one reducer. An order's lines
    are streamed through a hash aggregate, not held.
    """
    keys = _cell_keys()
    whole = F.col("dim") == "all"
    amount = F.col("total_amount")
    cells = F.filter(F.array(*(F.struct(F.lit(d).alias("dim"), keys[d][0].cast("string").alias("key"),
                                        keys[d][1].cast("string").alias("sub")) for d in dims)),
                     lambda c: c["key"].isNotNull())
    flags = {f"{n}_orders": status_flag(s) for n, s in _ORDER_SETS.items()}
    counts = {n: status_flag(s) for n, s in _ROW_SETS.items()}
    # a row has a cell in every dimension: a task for each of them, too, or the per-order step outgrows its memory
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(dims)
    dealt = (df.withColumn("_apart", F.when(F.col("order_id").isNull(), F.spark_partition_id()))
             .repartition(tasks, "order_id", "_apart"))
    named = dealt.select("order_id", "_apart", "order_date", amount, "item_quantity", "suborder_quantity", "order_quantity",
                         *(c.alias(n) for n, c in {**flags, **counts}.items()),
                         F.when(F.col("payment_mode") == "COD", 1).otherwise(0).alias("cod"),
                         F.when(F.col("sku") == label_or_unknown("sku"), 1).otherwise(0).alias("plain"), F.inline(cells))
    d = amount.cast("double")
    sums = {"rev": amount, "item_units": F.col("item_quantity"), "suborder_units": F.col("suborder_quantity"),
            "order_units": F.col("order_quantity"), "cod": F.col("cod"), **{n: F.col(n) for n in counts},
            "amt_n": F.when(amount.isNotNull(), 1).otherwise(0),
            "squares": F.when(whole, F.expr("try_multiply(total_amount, total_amount)")), "squares_double": F.when(whole, d * d)}
    summed = lambda n, c: (F.try_sum(c) if n == "squares" else F.sum(c)).alias(n)
    spans = {"amt_min": (F.min, "total_amount"), "amt_max": (F.max, "total_amount"), "first": (F.min, "order_date"),
             "last": (F.max, "order_date")}
    per_order = named.groupBy("dim", "key", "sub", "order_id", "_apart").agg(
        F.count(F.lit(1)).alias("rows"), *(summed(n, c) for n, c in sums.items()),
        *(F.max(n).alias(n) for n in (*flags, "plain")), *(f(c).alias(n) for n, (f, c) in spans.items()))
    known = F.col("order_id").isNotNull()
    return per_order.groupBy("dim", "key", "sub").agg(
        F.count("order_id").alias("orders"), F.sum("rows").alias("rows"), *(summed(n, F.col(n)) for n in sums),
        *(F.coalesce(F.sum(F.when(known, F.col(n))), F.lit(0)).alias(n) for n in flags), F.max("plain").alias("plain"),
        *(f(n).alias(n) for n, (f, _) in spans.items()))


def bundle_cells(df: DataFrame, *categories: str) -> DataFrame:
    """The cells of some categories, written to the shared scratch folder by dimension: read many times, made once."""
    dims = tuple(dict.fromkeys(d for c in categories for d in DIMS[c]))
    path = scratch_path(df.sparkSession, "orderlens-bundle", uuid.uuid4().hex)
    made = cells_of(df, dims)
    made.write.partitionBy("dim").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def _cells(cells: DataFrame, dim: str, key: str) -> DataFrame:
    return cells.where(F.col("dim") == dim).withColumnRenamed("key", key)


def totals(cells: DataFrame) -> DataFrame:
    """One row for the whole table (also for an empty one); ``skus`` where the SKU cells were made."""
    whole = F.col("dim") == "all"
    plain = (F.col("dim") == "odd_sku") | ((F.col("dim") == "sku") & (F.col("plain") == 1))
    names = [c for c in cells.columns if c not in ("dim", "key", "sub", "plain")]
    row = cells.where(F.col("dim").isin("all", "sku", "odd_sku")).agg(
        *(F.max(F.when(whole, F.col(c))).alias(c) for c in names), F.count(F.when(plain, 1)).alias("skus"))
    n, rev = F.col("amt_n").cast("double"), F.col("rev").cast("double")
    # exact decimal squares, less the exact mean's share; doubles only where the decimals overflow
    exact = F.expr("try_subtract(squares, try_divide(try_multiply(cast(rev as decimal(38, 4)), rev), amt_n))").cast("double")
    spread = F.greatest(F.coalesce(exact, F.col("squares_double") - rev * rev / n), F.lit(0.0))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("orders", "rows", "cod", *_ROW_SETS,
                                                              *(f"{n}_orders" for n in _ORDER_SETS))}
    return row.select(*(zero.get(c, F.col(c)) for c in row.columns),
                      F.coalesce("item_units", F.lit(0)).cast("bigint").alias("units"),
                      F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("amt_std"),
                      (F.floor(F.expr("timestampdiff(SECOND, first, last)") / 86400) + 1).cast("bigint").alias("period_days"))


def sku_cells(cells: DataFrame) -> DataFrame:
    """The per-SKU aggregate of M2, M3 and M6, with C20's unit column chosen from the whole table's sums."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    choice = totals(cells).select(F.when(some("item_units") > 0, 1).when(some("suborder_units") > 0, 2).otherwise(3)).scalar()
    own = F.col("dim") == "sku"
    names = {"orders": "order_count", "rev": "_rev", "item_units": "_iq", "suborder_units": "_sq", "order_units": "_oq"}
    per = cells.where(F.col("dim").isin("sku", "style")).groupBy(F.col("key").alias("_sku")).agg(
        *(F.max(F.when(own, F.col(c))).alias(n) for c, n in names.items()), F.min("sub").alias("_style"))
    return per.withColumn("_units", F.when(choice == 1, some("_iq")).when(choice == 2, some("_sq")).otherwise(some("_oq")))


def _long(df: DataFrame, category: str, metric: str, key: Column | str | None, value: Column | str) -> DataFrame:
    k = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(F.lit(category).alias("category"), F.lit(metric).alias("metric"), k.alias("key"), v.alias("value"))


def _long_multi(df: DataFrame, category: str, key: Column | str | None, metrics_: dict[str, Column | str]) -> DataFrame:
    """Several metrics of ONE aggregated frame in long form: one projection (``inline``),
    so the aggregate under it is computed once instead of once per metric."""
    k = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    items = [F.struct(F.lit(m).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"))
             for m, v in metrics_.items()]
    return df.select(k.alias("key"), F.inline(F.array(*items))).select(
        F.lit(category).alias("category"), "metric", "key", "value")


def _row_metrics(category: str, row: DataFrame) -> DataFrame:
    """Unpivot a one-row frame into long form (metric = column name)."""
    cols = [c for c in row.columns]
    long = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in cols])))
    return long.select(F.lit(category).alias("category"), "metric", F.lit(None).cast("string").alias("key"), "value")


def primary_kpis(cells: DataFrame) -> DataFrame:
    """B2: K0 values plus monthly orders / revenue series and their growth."""
    rev = F.coalesce(F.col("rev"), F.lit(0))
    row = totals(cells).select(
        F.col("orders").alias("total_orders"), F.col("units").alias("units_sold"), money(rev).alias("gross_revenue"),
        ratio(rev, F.col("orders")).alias("aov"), F.col("skus").alias("unique_skus"),
        status_rate("cancelled_orders").alias("cancellation_rate"), status_rate("rto_orders").alias("return_rate"),
        F.round(safe_pct(F.col("cod"), F.col("rows")), 2).alias("cod_share"),
        status_rate("delivered_orders").alias("delivered_rate"))
    parts = [_row_metrics("primary", row)]
    monthly = _cells(cells, "month", "month").select(F.concat("month", F.lit("-01")).alias("bucket"), "orders",
                                                     money(F.col("rev")).alias("revenue"))
    monthly = monthly.withColumns({"orders_growth": growth_series("orders"), "revenue_growth": growth_series("revenue")})
    parts.append(_long_multi(monthly, "primary", "bucket", {
        f"{m}_series": m for m in ("orders", "revenue", "orders_growth", "revenue_growth")}))
    return reduce(DataFrame.union, parts)


def _scalar_parts(cells: DataFrame, category: str, exprs: dict[str, Column]) -> DataFrame:
    return _row_metrics(category, totals(cells).select(*[c.alias(n) for n, c in exprs.items()]))


def product_metrics(cells: DataFrame) -> DataFrame:
    """B3 (raw-size row counts) and B4 (SKU lists)."""
    parts = [_scalar_parts(cells, "product", {
        "sku_diversity_index": ratio(F.col("skus"), F.col("orders"), 4),
        "avg_units_per_order": ratio(F.col("units"), F.col("orders"))})]
    per = sku_cells(cells)
    parts.append(_long(metrics.revenue_list(per, 5), "product", "top_skus_by_revenue", "sku", "revenue"))
    parts.append(_long(metrics.units_list(per, 5), "product", "top_skus_by_units", "sku", "units"))
    parts.append(_long(metrics.performance_list(per, 10), "product", "sku_performance_revenue", "sku", "revenue"))
    sizes = _cells(cells, "size", "size").select("size", F.col("rows").alias("count"))
    total = sizes.agg(F.sum("count")).scalar()
    parts.append(_long_multi(sizes, "product", "size", {
        "size_mix_count": "count", "size_mix_pct": F.round(safe_pct(F.col("count"), total), 2)}))
    return reduce(DataFrame.union, parts)


def sku_detail_rows(cells: DataFrame, n: int = 5, n_performance: int = 10) -> DataFrame:
    """B4 (detail): every column of the SKU lists, one row per list and rank, from the SKU cells.

    (list, rank, sku, style_name, revenue, order_count, units, aov, revenue_per_unit, units_per_order)
    """
    per = sku_cells(cells)
    lists = [("top_skus_by_revenue", metrics.revenue_list(per, n), "revenue"),
             ("top_skus_by_units", metrics.units_list(per, n), "units"),
             ("sku_performance", metrics.performance_list(per, n_performance), "revenue")]
    parts = []
    for name, rows, by in lists:
        rank = F.row_number().over(Window.orderBy(F.col(by).desc(), F.col("sku")))   # over the list's rows
        have = set(rows.columns)
        parts.append(rows.select(F.lit(name).alias("list"), rank.alias("rank"), "sku", "style_name", "revenue", "order_count",
                                 "units", *((F.col(c) if c in have else F.lit(None)).cast("double").alias(c)
                                            for c in ("aov", "revenue_per_unit", "units_per_order"))))
    return reduce(DataFrame.unionByName, parts)


def performance_metrics(cells: DataFrame, df: DataFrame) -> DataFrame:
    """B5 (fulfilment over rows) and B6 (value distribution, velocities); the median reads the rows themselves."""
    median = exact_quantile(df, F.col("total_amount").cast("double"), 0.5)
    daily = F.coalesce(F.try_divide(F.col("orders").cast("double"), F.col("period_days").cast("double")), F.lit(0.0))
    return _scalar_parts(cells, "performance", {
        "fulfillment_rate": F.round(safe_pct(F.col("fulfilled"), F.col("rows")), 2),
        "order_value_min": money(F.col("amt_min")), "order_value_max": money(F.col("amt_max")),
        "order_value_mean": ratio(F.col("rev"), F.col("amt_n")),
        "order_value_median": F.round(median, 2), "order_value_std": F.round(F.col("amt_std"), 2),
        "order_velocity_daily": F.round(daily, 2),
        "units_velocity": ratio(F.col("units"), F.col("period_days"))})


def geographic_metrics(cells: DataFrame, n: int = 10) -> DataFrame:
    """B7 (top states by revenue / rows, concentration) and B8 (state cancel rates > 0, top n)."""
    per = _cells(cells, "state", "_state").withColumnRenamed("rev", "_rev")
    top_rev = per.orderBy(F.col("_rev").desc(), F.col("_state").asc()).limit(n)
    tot_top = top_rev.agg(F.sum("_rev")).scalar()
    top_rows = per.orderBy(F.col("rows").desc(), F.col("_state").asc()).limit(n)
    tot_rows = top_rows.agg(F.sum("rows")).scalar()
    conc = metrics.concentration_of(per).select("concentration_pct").limit(1)
    rates = per.withColumn("rate", status_rate("cancelled_orders")).where(F.col("rate") > 0)
    top_rates = rates.orderBy(F.col("rate").desc(), F.col("_state").asc()).limit(n)
    parts = [_long_multi(top_rev, "geographic", "_state", {
                 "top_states_by_revenue": money(F.col("_rev")),
                 "top_states_by_revenue_pct": F.round(safe_pct(F.col("_rev"), tot_top), 2)}),
             _long_multi(top_rows, "geographic", "_state", {
                 "top_states_by_rows": "rows", "top_states_by_rows_pct": F.round(safe_pct(F.col("rows"), tot_rows), 2)}),
             _long(conc, "geographic", "geo_concentration", None, "concentration_pct"),
             _long(top_rates, "geographic", "state_cancellation_rate", "_state", "rate")]
    return reduce(DataFrame.union, parts)


def channel_metrics(cells: DataFrame) -> DataFrame:
    """B9 (marketplace / courier / warehouse) and B10 (row shares)."""
    g = cells.where(F.col("dim").isin("marketplace", "courier", "warehouse")).select(
        "dim", F.col("key").alias("k"), "orders", money(F.col("rev")).alias("revenue"),
        ratio(F.col("rev"), F.col("orders")).alias("aov"))
    per_metric = F.array(*[F.struct(F.concat(F.col("dim"), F.lit(f"_{m}")).alias("metric"),
                                    F.col(m).cast("double").alias("value")) for m in ("orders", "revenue", "aov")])
    parts = [g.select(F.col("k").cast("string").alias("key"), F.inline(per_metric))
             .select(F.lit("channel").alias("category"), "metric", "key", "value")]
    for col, cat, name in (("payment_mode", "channel", "payment_mode_share"), ("order_type", "order_type", "order_type_share")):
        cnt = _cells(cells, col, col).select(col, F.col("rows").alias("n"))
        tot = cnt.agg(F.sum("n")).scalar()
        parts.append(_long(cnt.withColumn("p", F.round(safe_pct(F.col("n"), tot), 2)), cat, name, col, "p"))
    return reduce(DataFrame.union, parts)


def quality_metrics(cells: DataFrame) -> DataFrame:
    """B5 again (overall fulfilment), B11 (issue rate over rows), B12 (marketplace risk of the union)."""
    risk = _cells(cells, "marketplace", "_mp").withColumn("score", status_rate("risk_orders"))
    parts = [_scalar_parts(cells, "quality", {
                 "overall_fulfillment": F.round(safe_pct(F.col("fulfilled"), F.col("rows")), 2),
                 "overall_issue_rate": F.round(safe_pct(F.col("issues"), F.col("rows")), 2)}),
             _long(risk, "quality", "marketplace_risk_score", "_mp", "score")]
    return reduce(DataFrame.union, parts)


def advanced_metrics(cells: DataFrame) -> DataFrame:
    """Revenue per marketplace; monthly orders and revenue."""
    return _long(_cells(cells, "marketplace", "k"), "advanced", "revenue_per_marketplace", "k", money(F.col("rev"))).union(
        _long_multi(_cells(cells, "month", "k"), "advanced", "k", {"monthly_orders": "orders",
                                                                   "monthly_revenue": money(F.col("rev"))}))


def batch_all_metrics(df: DataFrame) -> DataFrame:
    """B1: every category from the fetched frame, one long-form result."""
    cells = bundle_cells(df, *DIMS)
    return reduce(DataFrame.union, [primary_kpis(cells), product_metrics(cells), performance_metrics(cells, df),
                                    geographic_metrics(cells), channel_metrics(cells), quality_metrics(cells),
                                    advanced_metrics(cells)])
