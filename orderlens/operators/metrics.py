"""Metric endpoints.

Per-dimension rates use the order-level pre-aggregate (``status_order_counts``);
shares of a total use scalar subqueries over the aggregated rows; top-n lists
use ``orderBy(value desc, key asc).limit(n)`` so ties are deterministic.
The value-based unit column (C20) is chosen by one global aggregate that
Spark runs once as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import label_or_unknown, money, normalize_order_type, normalize_payment_member, ratio, safe_pct
from ..functions.quantiles import exact_quantiles
from .core import status_order_counts, status_rate
from .kpis import CANCELLED, RTO

# Fixed status sets of the metric definitions.
FULFILLED = ["Manifest Scanned", "Shipped"]            # M7, M20: SHIPPING_START and DELIVERED members
COURIER_DELIVERY = ["Delivered", "Manifest Scanned"]   # M16


def units_by_value(df: DataFrame) -> Column:
    """C20: the first quantity column whose global sum is positive (item → suborder → order)."""
    choice = df.agg(F.when(F.coalesce(F.sum("item_quantity"), F.lit(0)) > 0, 1)
                    .when(F.coalesce(F.sum("suborder_quantity"), F.lit(0)) > 0, 2).otherwise(3)).scalar()
    return (F.when(choice == 1, F.coalesce(F.col("item_quantity"), F.lit(0)))
            .when(choice == 2, F.coalesce(F.col("suborder_quantity"), F.lit(0)))
            .otherwise(F.coalesce(F.col("order_quantity"), F.lit(0))))


def _clean(c: str) -> Column:
    return label_or_unknown(c)


def _top(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(n)


def sku_diversity_index(df: DataFrame) -> DataFrame:
    """M1: distinct SKUs ÷ distinct orders (4 places)."""
    row = df.agg(F.countDistinct("sku").alias("unique_skus"), F.countDistinct("order_id").alias("total_orders"))
    return row.select(ratio(F.col("unique_skus"), F.col("total_orders"), 4).alias("value"), "unique_skus", "total_orders")


_SKU_BASE: dict[int, tuple[DataFrame, DataFrame]] = {}


def _sku_base(df: DataFrame) -> DataFrame:
    """Per-SKU aggregate shared by M2, M3, M6 (built once per input frame)."""
    hit = _SKU_BASE.get(id(df))
    if hit is None or hit[0] is not df:
        hit = _SKU_BASE[id(df)] = (df, _build_sku_base(df, units_by_value(df)))
    return hit[1]


def _build_sku_base(df: DataFrame, units: Column) -> DataFrame:
    return (df.withColumn("_sku", _clean("sku"))
            .groupBy("_sku").agg(F.countDistinct("order_id").alias("order_count"),
                                 F.sum("total_amount").alias("_rev"),
                                 F.sum(units).alias("_units"),
                                 F.sum("item_quantity").alias("_iq"), F.sum("suborder_quantity").alias("_sq"),
                                 F.sum("order_quantity").alias("_oq"),
                                 F.min("suborder_model_no").alias("_style")))


def top_skus_by_revenue(df: DataFrame, n: int = 5) -> DataFrame:
    """M2: top-n SKUs (trimmed raw SKU) by revenue; units fall back per SKU."""
    return revenue_list(_sku_base(df), n)


def revenue_list(per: DataFrame, n: int) -> DataFrame:
    """M2 from the per-SKU aggregate."""
    units = F.when(F.coalesce(F.col("_iq"), F.lit(0)) > 0, F.col("_iq")).otherwise(F.coalesce(F.col("_sq"), F.col("_oq")))
    return _top(per, "_rev", "_sku", n).select(
        F.col("_sku").alias("sku"), F.coalesce(F.col("_style"), F.lit("")).alias("style_name"),
        money(F.col("_rev")).alias("revenue"), "order_count",
        F.coalesce(units, F.lit(0)).cast("bigint").alias("units"), ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def top_skus_by_units(df: DataFrame, n: int = 5) -> DataFrame:
    """M3: top-n SKUs by units (value-based unit column)."""
    return units_list(_sku_base(df), n)


def units_list(per: DataFrame, n: int) -> DataFrame:
    """M3 from the per-SKU aggregate."""
    return _top(per, "_units", "_sku", n).select(
        F.col("_sku").alias("sku"), F.coalesce(F.col("_style"), F.lit("")).alias("style_name"),
        F.col("_units").cast("bigint").alias("units"), "order_count", money(F.col("_rev")).alias("revenue"),
        ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def average_units_per_order(df: DataFrame) -> DataFrame:
    """M4."""
    row = df.agg(F.coalesce(F.sum("item_quantity"), F.lit(0)).cast("bigint").alias("total_units"),
                 F.countDistinct("order_id").alias("total_orders"))
    return row.select(ratio(F.col("total_units"), F.col("total_orders")).alias("value"), "total_units", "total_orders")


def size_mix_distribution(df: DataFrame) -> DataFrame:
    """M5: units per size bucket and share of all units."""
    per = df.groupBy("size_bucket").agg(F.sum(units_by_value(df)).cast("bigint").alias("units"))
    total = per.agg(F.sum("units")).scalar()
    return per.select(F.col("size_bucket").alias("size"), "units", F.round(safe_pct(F.col("units"), total), 2).alias("percentage"),
                      total.cast("bigint").alias("total_units"))


def sku_performance_matrix(df: DataFrame, n: int = 20) -> DataFrame:
    """M6: top-n SKUs by revenue with revenue per unit and units per order."""
    return performance_list(_sku_base(df), n)


def performance_list(per: DataFrame, n: int) -> DataFrame:
    """M6 from the per-SKU aggregate."""
    return _top(per, "_rev", "_sku", n).select(
        F.col("_sku").alias("sku"), F.coalesce(F.col("_style"), F.lit("")).alias("style_name"),
        money(F.col("_rev")).alias("revenue"), F.col("_units").cast("bigint").alias("units"), "order_count",
        ratio(F.col("_rev"), F.col("_units")).alias("revenue_per_unit"),
        ratio(F.col("_units"), F.col("order_count")).alias("units_per_order"))


def fulfillment_rate(df: DataFrame) -> DataFrame:
    """Fulfilled ROWS (Manifest Scanned, Shipped) ÷ distinct orders — may exceed 100 (Q9)."""
    row = df.agg(F.count(F.when(F.col("order_status").isin(FULFILLED), 1)).alias("fulfilled_orders"),
                 F.countDistinct("order_id").alias("total_orders"))
    return row.select(F.round(safe_pct(F.col("fulfilled_orders"), F.col("total_orders")), 2).alias("value"),
                      "fulfilled_orders", "total_orders")


def order_value_distribution(df: DataFrame) -> DataFrame:
    """M8: exact linear percentiles, min, max, mean and sample std of line amounts."""
    v = F.col("total_amount").cast("double")
    q = exact_quantiles(df, v, [0.25, 0.5, 0.75])
    return df.agg(
        F.round(q[0.25], 2).alias("p25"), F.round(q[0.5], 2).alias("median"), F.round(q[0.75], 2).alias("p75"),
        money(F.min("total_amount")).alias("min"), money(F.max("total_amount")).alias("max"),
        ratio(F.sum("total_amount"), F.count("total_amount")).alias("mean"),
        F.round(F.stddev_samp(v), 2).alias("std_dev"))


def _span_days() -> Column:
    return (F.floor(F.expr("timestampdiff(SECOND, min(order_date), max(order_date))") / 86400) + 1).cast("bigint")


def order_velocity(df: DataFrame) -> DataFrame:
    """M9: orders per day / week / month over the observed span (whole 24 h periods + 1)."""
    row = df.where(F.col("order_date").isNotNull()).agg(_span_days().alias("period_days"),
                                                        F.countDistinct("order_id").alias("total_orders"))
    daily = F.coalesce(F.try_divide(F.col("total_orders").cast("double"), F.col("period_days").cast("double")), F.lit(0.0))
    return row.select(F.round(daily, 2).alias("daily"), F.round(daily * 7, 2).alias("weekly"),
                      F.round(daily * 30, 2).alias("monthly"), "period_days", "total_orders")


def units_velocity(df: DataFrame) -> DataFrame:
    """Units per day over the observed span."""
    row = df.where(F.col("order_date").isNotNull()).agg(
        _span_days().alias("period_days"), F.coalesce(F.sum("item_quantity"), F.lit(0)).cast("bigint").alias("total_units"))
    return row.select(ratio(F.col("total_units"), F.col("period_days")).alias("value"), "total_units", "period_days")


def _state_totals(df: DataFrame) -> DataFrame:
    return (df.withColumn("_state", _clean("state")).groupBy("_state")
            .agg(F.sum("total_amount").alias("_rev"), F.countDistinct("order_id").alias("order_count")))


def top_states_by_revenue(df: DataFrame, n: int = 5) -> DataFrame:
    """Top-n states by revenue; share of the top-n total (Q8)."""
    top = _top(_state_totals(df), "_rev", "_state", n)
    total = top.agg(F.sum("_rev")).scalar()
    return top.select(F.col("_state").alias("state"), money(F.col("_rev")).alias("revenue"), "order_count",
                      F.round(safe_pct(F.col("_rev"), total), 2).alias("revenue_share"),
                      ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def top_states_by_orders(df: DataFrame, n: int = 5) -> DataFrame:
    """Top-n states by distinct orders; share of the top-n order total."""
    top = _top(_state_totals(df), "order_count", "_state", n)
    total = top.agg(F.sum("order_count")).scalar()
    return top.select(F.col("_state").alias("state"), "order_count",
                      F.round(safe_pct(F.col("order_count"), total), 2).alias("order_share"),
                      money(F.col("_rev")).alias("revenue"), ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def geographic_revenue_concentration(df: DataFrame, n: int = 3) -> DataFrame:
    """Revenue share of the top-n states and a risk level (>70 HIGH, >50 MEDIUM)."""
    return concentration_of(_state_totals(df), n)


def concentration_of(per: DataFrame, n: int = 3) -> DataFrame:
    """M13 from the totals per state."""
    top = _top(per, "_rev", "_state", n)
    total = per.agg(F.sum("_rev")).scalar()
    conc = F.round(safe_pct(top.agg(F.sum("_rev")).scalar(), total), 2)
    return top.select(F.col("_state").alias("state"), money(F.col("_rev")).alias("revenue"),
                      F.round(safe_pct(F.col("_rev"), total), 2).alias("revenue_pct"),
                      conc.alias("concentration_pct"),
                      F.when(conc > 70, "HIGH").when(conc > 50, "MEDIUM").otherwise("LOW").alias("risk_level"))


def _dim_rates(df: DataFrame, col: str, sets: dict, sums: dict | None = None) -> DataFrame:
    return status_order_counts(df.withColumn("_k", _clean(col)), ["_k"], sets, sums)


def state_cancellation_rates(df: DataFrame) -> DataFrame:
    """Per state cancellation, RTO and issue (sum) rates over distinct orders (Q6: built as intended)."""
    per = _dim_rates(df, "state", {"c": CANCELLED, "r": RTO})
    c, r = safe_pct(F.col("c_orders"), F.col("orders")), safe_pct(F.col("r_orders"), F.col("orders"))
    return per.select(F.col("_k").alias("state"), F.col("orders").alias("total_orders"), F.round(c, 2).alias("cancellation_rate"),
                      F.round(r, 2).alias("rto_rate"), F.round(c + r, 2).alias("issue_rate"))


def marketplace_performance(df: DataFrame) -> DataFrame:
    """M15."""
    per = _dim_rates(df, "marketplace", {"c": CANCELLED}, {"_rev": F.col("total_amount")})
    return per.select(F.col("_k").alias("marketplace"), money(F.col("_rev")).alias("revenue"), F.col("orders").alias("order_count"),
                      ratio(F.col("_rev"), F.col("orders")).alias("aov"), status_rate("c_orders").alias("cancellation_rate"))


def courier_performance(df: DataFrame) -> DataFrame:
    """Delivery {Delivered, Manifest Scanned}, cancel and RTO rates per courier."""
    per = _dim_rates(df, "courier", {"d": COURIER_DELIVERY, "c": CANCELLED, "r": RTO})
    return per.select(F.col("_k").alias("courier"), F.col("orders").alias("order_count"),
                      status_rate("d_orders").alias("delivery_rate"), status_rate("c_orders").alias("cancellation_rate"),
                      status_rate("r_orders").alias("rto_rate"))


def warehouse_efficiency(df: DataFrame) -> DataFrame:
    """M17."""
    per = (df.withColumn("_k", _clean("import_warehouse_name")).groupBy("_k")
           .agg(F.countDistinct("order_id").alias("order_count"), F.sum("total_amount").alias("_rev")))
    return per.select(F.col("_k").alias("warehouse"), "order_count", money(F.col("_rev")).alias("revenue"),
                      ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def _mix_breakdown(df: DataFrame, key: Column, name: str, with_units: bool) -> DataFrame:
    sums = {"_rev": F.col("total_amount")}
    if with_units:
        sums["_units"] = units_by_value(df)
    per = status_order_counts(df.withColumn("_k", key).where(F.col("_k").isNotNull()), ["_k"], {"c": CANCELLED}, sums)
    tot_o, tot_r = per.agg(F.sum("orders")).scalar(), per.agg(F.sum("_rev")).scalar()
    cols = [F.col("_k").alias(name), F.col("orders").alias("order_count"), money(F.col("_rev")).alias("revenue"),
            ratio(F.col("_rev"), F.col("orders")).alias("aov")]
    if with_units:
        cols.append(F.col("_units").cast("bigint").alias("units"))
    else:
        cols.append(status_rate("c_orders").alias("cancellation_rate"))
    cols += [F.round(safe_pct(F.col("orders"), tot_o), 2).alias("order_pct"),
             F.round(safe_pct(F.col("_rev"), tot_r), 2).alias("revenue_pct")]
    return per.select(*cols)


def payment_mode_breakdown(df: DataFrame) -> DataFrame:
    """Per payment mode (member spelling) orders, revenue, AOV, cancel rate, order % and revenue %."""
    return _mix_breakdown(df, normalize_payment_member("payment_mode"), "payment_mode", with_units=False)


def order_type_breakdown(df: DataFrame) -> DataFrame:
    """Per order type orders, revenue, AOV, units, order % and revenue %."""
    return _mix_breakdown(df, normalize_order_type("order_type"), "order_type", with_units=True)


def overall_issue_rate(df: DataFrame) -> DataFrame:
    """(distinct cancelled + distinct RTO orders) ÷ distinct orders (Q10)."""
    per = status_order_counts(df, [], {"c": CANCELLED, "r": RTO})
    return per.select(F.round(safe_pct(F.col("c_orders") + F.col("r_orders"), F.col("orders")), 2).alias("value"),
                      F.col("c_orders").alias("cancelled_orders"), F.col("r_orders").alias("rto_orders"),
                      (F.col("c_orders") + F.col("r_orders")).alias("total_issue_orders"), F.col("orders").alias("total_orders"))


def payment_risk_analysis(df: DataFrame) -> DataFrame:
    """COD vs other cancel rates, their gap (pp) and a level (>15, >10, >5)."""
    is_cod = F.coalesce(normalize_payment_member("payment_mode") == "COD", F.lit(False))
    per = status_order_counts(df.withColumn("_cod", is_cod), ["_cod"], {"c": CANCELLED})
    agg = per.agg(*[F.coalesce(F.sum(F.when(F.col("_cod") == v, F.col(c))), F.lit(0)).alias(f"{p}_{c}")
                    for v, p in ((True, "cod"), (False, "pre")) for c in ("orders", "c_orders")])
    cod = safe_pct(F.col("cod_c_orders"), F.col("cod_orders"))
    pre = safe_pct(F.col("pre_c_orders"), F.col("pre_orders"))
    gap = cod - pre
    return agg.select(F.round(cod, 2).alias("cod_cancellation_rate"), F.round(pre, 2).alias("prepaid_cancellation_rate"),
                      F.round(gap, 2).alias("risk_increase_pp"), F.col("cod_orders").alias("cod_order_count"),
                      F.col("pre_orders").alias("prepaid_order_count"),
                      F.when(gap > 15, "CRITICAL").when(gap > 10, "HIGH").when(gap > 5, "MODERATE").otherwise("LOW")
                      .alias("risk_level"))


def marketplace_risk_score(df: DataFrame) -> DataFrame:
    """Cancel rate + RTO rate per marketplace; level (>30, >20, >10)."""
    per = _dim_rates(df, "marketplace", {"c": CANCELLED, "r": RTO})
    c, r = safe_pct(F.col("c_orders"), F.col("orders")), safe_pct(F.col("r_orders"), F.col("orders"))
    score = c + r
    return per.select(F.col("_k").alias("marketplace"), F.col("orders").alias("order_count"), F.round(c, 2).alias("cancellation_rate"),
                      F.round(r, 2).alias("rto_rate"), F.round(score, 2).alias("risk_score"),
                      F.when(score > 30, "CRITICAL").when(score > 20, "HIGH").when(score > 10, "MEDIUM").otherwise("LOW")
                      .alias("risk_level"))


def revenue_per_channel(df: DataFrame) -> DataFrame:
    """Revenue by marketplace, by courier and by warehouse in ONE grouping-sets pass."""
    keyed = df.select(_clean("marketplace").alias("marketplace"), _clean("courier").alias("courier"),
                      _clean("import_warehouse_name").alias("warehouse"), "total_amount")
    g = keyed.groupingSets([["marketplace"], ["courier"], ["warehouse"]], "marketplace", "courier", "warehouse").agg(
        F.sum("total_amount").alias("_rev"), F.grouping_id().alias("_gid"))
    dim = (F.when(F.col("_gid") == 3, "marketplace").when(F.col("_gid") == 5, "courier").otherwise("warehouse"))
    return g.select(dim.alias("dimension"), F.coalesce("marketplace", "courier", "warehouse").alias("key"),
                    money(F.col("_rev")).alias("revenue"))


def seasonal_trends(df: DataFrame) -> DataFrame:
    """Monthly orders, revenue and AOV."""
    per = (df.where(F.col("order_date").isNotNull()).groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month"))
           .agg(F.countDistinct("order_id").alias("order_count"), F.sum("total_amount").alias("_rev")))
    return per.select("year_month", "order_count", money(F.col("_rev")).alias("revenue"),
                      ratio(F.col("_rev"), F.col("order_count")).alias("aov"))


def product_payment_correlation(df: DataFrame) -> DataFrame:
    """Units per size split by COD vs other; sizes with units only."""
    is_cod = F.coalesce(normalize_payment_member("payment_mode") == "COD", F.lit(False))
    u = units_by_value(df)
    per = df.groupBy("size_bucket").agg(F.sum(F.when(is_cod, u).otherwise(0)).cast("bigint").alias("cod_units"),
                                        F.sum(F.when(~is_cod, u).otherwise(0)).cast("bigint").alias("prepaid_units"))
    tot = F.col("cod_units") + F.col("prepaid_units")
    return per.where(tot > 0).select(
        F.col("size_bucket").alias("size"), "cod_units", F.round(safe_pct(F.col("cod_units"), tot), 2).alias("cod_pct"),
        "prepaid_units", F.round(safe_pct(F.col("prepaid_units"), tot), 2).alias("prepaid_pct"), tot.alias("total_units"))
