"""KPI bundle, KPI cards, period comparisons and KPI trends (K0–K12, KT1–KT9).

All functions take the *fetched* history frame (``plans.history.fetch``) —
or, for comparisons, the history table plus a request — and return a small
DataFrame. Status-rate denominators are distinct orders (A3), COD share is
over rows (K8), as the route definitions state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import growth_pct, money, ratio, safe_pct
from ..functions.timebuckets import finish_series, grain_from_window, with_bucket
from ..plans.history import fetch_two_windows
from ..plans.request import HistoryRequest, quarter_windows, trailing_windows
from .core import status_flag, status_order_counts, status_rate

# Fixed status sets of the KPI definitions.
CANCELLED = ["Cancelled"]
RTO = ["RTO"]
DELIVERED_LITERAL = ["Delivered"]   # K0, KT9: the literal text (never produced by the enum)
DELIVERED_MEMBER = ["Shipped"]      # K9: the enum member DELIVERED, whose value is Shipped


def _cod_row() -> Column:
    return F.when(F.col("payment_mode") == "COD", 1).otherwise(0)


def kpi_bundle(df: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
    """K0: the nine headline KPIs, in one row or one per value of ``dims``, from one scan.

    Orders and SKUs are two grouping sets of one aggregate, combined before its
    shuffle; the distinct counts are then the numbers of their rows.
    """
    sets = {"cancelled": CANCELLED, "rto": RTO, "delivered": DELIVERED_LITERAL}
    sums = {"_amount": F.col("total_amount"), "_units": F.col("item_quantity"), "_cod": _cod_row()}
    narrow = df.select(*dims, "order_id", "sku", *(status_flag(s).alias(f"{n}_orders") for n, s in sets.items()),
                       *(c.alias(n) for n, c in sums.items()))
    per = narrow.groupingSets([[*dims, "order_id"], [*dims, "sku"]], *dims, "order_id", "sku").agg(
        *(F.max(f"{n}_orders").alias(f"{n}_orders") for n in sets), *(F.sum(n).alias(n) for n in sums),
        F.count(F.lit(1)).alias("rows"), (F.grouping("order_id") == 0).alias("_order"))
    order, known = F.col("_order"), F.col("_order") & F.col("order_id").isNotNull()
    row = per.groupBy(*dims).agg(
        F.count(F.when(known, 1)).alias("orders"), F.count(F.when(~order & F.col("sku").isNotNull(), 1)).alias("unique_skus"),
        *(F.coalesce(F.sum(F.when(known, F.col(f"{n}_orders"))), F.lit(0)).alias(f"{n}_orders") for n in sets),
        *(F.sum(F.when(order, F.col(n))).alias(n) for n in (*sums, "rows")))
    rev = F.coalesce(F.col("_amount"), F.lit(0))
    return row.select(
        *dims, F.col("orders").alias("total_orders"),
        F.coalesce(F.col("_units"), F.lit(0)).cast("bigint").alias("units_sold"),
        money(rev).alias("gross_revenue"),
        ratio(rev, F.col("orders")).alias("aov"),
        F.coalesce(F.col("unique_skus"), F.lit(0)).alias("unique_skus"),
        status_rate("cancelled_orders").alias("cancellation_rate"),
        status_rate("rto_orders").alias("return_rate"),
        F.round(safe_pct(F.col("_cod"), F.col("rows")), 2).alias("cod_share"),
        status_rate("delivered_orders").alias("delivered_rate"),
    )


# ---- K1–K9: single cards -------------------------------------------------

def kpi_total_orders(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("order_id").alias("value"))


def kpi_units_sold(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("item_quantity"), F.lit(0)).cast("bigint").alias("value"))


def kpi_gross_revenue(df: DataFrame) -> DataFrame:
    return df.agg(money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("value"))


def kpi_aov_row_mean(df: DataFrame) -> DataFrame:
    """K4: mean of ``total_amount`` over rows."""
    return df.agg(ratio(F.sum("total_amount"), F.count("total_amount")).alias("value"))


def kpi_unique_skus(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("sku").alias("value"))


def _rate_card(df: DataFrame, statuses: list[str]) -> DataFrame:
    per = status_order_counts(df, [], {"m": statuses})
    return per.select(status_rate("m_orders").alias("value"))


def kpi_cancellation_rate(df: DataFrame) -> DataFrame:
    return _rate_card(df, CANCELLED)


def kpi_return_rate(df: DataFrame) -> DataFrame:
    return _rate_card(df, RTO)


def kpi_cod_share(df: DataFrame) -> DataFrame:
    """K8: COD rows ÷ rows."""
    return df.agg(F.round(safe_pct(F.sum(_cod_row()), F.count(F.lit(1))), 2).alias("value"))


def kpi_delivered_rate(df: DataFrame) -> DataFrame:
    """K9: ``Shipped`` rows ÷ rows."""
    shipped = F.when(F.col("order_status").isin(DELIVERED_MEMBER), 1).otherwise(0)
    return df.agg(F.round(safe_pct(F.sum(shipped), F.count(F.lit(1))), 2).alias("value"))


# ---- K10–K12: two-window comparisons (A5) --------------------------------

def window_comparison(history: DataFrame, req: HistoryRequest, cur: tuple, prev: tuple) -> DataFrame:
    """A5: orders / revenue / units / AOV for both windows from ONE scan, plus deltas."""
    tagged = fetch_two_windows(history, req, cur, prev)
    per = (tagged.groupBy("window")
           .agg(F.countDistinct("order_id").alias("orders"),
                F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"),
                F.coalesce(F.sum("item_quantity"), F.lit(0)).cast("bigint").alias("units")))
    wide = (per.groupBy().pivot("window", ["current", "previous"])
            .agg(F.first("orders").alias("orders"), F.first("revenue").alias("revenue"),
                 F.first("units").alias("units")))
    raw = {}
    for w, p in (("current", "cur"), ("previous", "prev")):
        orders = F.coalesce(F.col(f"{w}_orders"), F.lit(0)).cast("bigint")
        rev = F.coalesce(F.col(f"{w}_revenue"), F.lit(0))
        raw[f"{p}_orders"] = orders
        raw[f"{p}_revenue_exact"] = rev
        raw[f"{p}_units"] = F.coalesce(F.col(f"{w}_units"), F.lit(0)).cast("bigint")
    wide = wide.select(*[c.alias(n) for n, c in raw.items()])
    for p in ("cur", "prev"):
        wide = wide.withColumns({
            f"{p}_revenue_d": F.col(f"{p}_revenue_exact").cast("double"),
            f"{p}_aov_d": F.coalesce(F.try_divide(F.col(f"{p}_revenue_exact").cast("double"),
                                                  F.col(f"{p}_orders").cast("double")), F.lit(0.0))})
    deltas = {
        "orders_pct": F.round(growth_pct(F.col("cur_orders"), F.col("prev_orders")), 2),
        "revenue_pct": F.round(growth_pct(F.col("cur_revenue_d"), F.col("prev_revenue_d")), 2),
        "units_pct": F.round(growth_pct(F.col("cur_units"), F.col("prev_units")), 2),
        "aov_pct": F.round(growth_pct(F.col("cur_aov_d"), F.col("prev_aov_d")), 2),
    }
    return wide.select(
        F.lit(cur[0].isoformat()).alias("cur_start"), F.lit(cur[1].isoformat()).alias("cur_end"),
        F.lit(prev[0].isoformat()).alias("prev_start"), F.lit(prev[1].isoformat()).alias("prev_end"),
        "cur_orders", money(F.col("cur_revenue_exact")).alias("cur_revenue"), "cur_units",
        F.round("cur_aov_d", 2).alias("cur_aov"),
        "prev_orders", money(F.col("prev_revenue_exact")).alias("prev_revenue"), "prev_units",
        F.round("prev_aov_d", 2).alias("prev_aov"),
        *[c.alias(n) for n, c in deltas.items()])


def kpi_comparison_days(history: DataFrame, req: HistoryRequest, days: int) -> DataFrame:
    """K10 (days=30) / K11 (days=7): trailing window ending at the request end."""
    cs, ce, ps, pe = trailing_windows(req.end, days)
    return window_comparison(history, req, (cs, ce), (ps, pe))


def kpi_comparison_quarter(history: DataFrame, req: HistoryRequest) -> DataFrame:
    """Quarter-to-date vs the whole previous quarter."""
    cs, ce, ps, pe = quarter_windows(req.end)
    return window_comparison(history, req, (cs, ce), (ps, pe))


# ---- KT1–KT9: trends ------------------------------------------------------

TREND_METRICS = ["total_orders", "units_sold", "gross_revenue", "aov", "unique_skus",
                 "cancellation_rate", "rto_rate", "cod_share", "delivered_rate"]


def kpi_trend(df: DataFrame, req: HistoryRequest, metric: str) -> DataFrame:
    """KT1–KT9: one value per time bucket; grain from the request window."""
    grain = grain_from_window(req.start, req.end)
    b = with_bucket(df, grain)
    if metric == "total_orders":
        agg = b.groupBy("_bucket").agg(F.countDistinct("order_id").alias("value"))
    elif metric == "units_sold":
        agg = b.groupBy("_bucket").agg(F.sum("item_quantity").cast("bigint").alias("value"))
    elif metric == "gross_revenue":
        agg = b.groupBy("_bucket").agg(money(F.sum("total_amount")).alias("value"))
    elif metric == "aov":
        agg = b.groupBy("_bucket").agg(ratio(F.sum("total_amount"), F.count("total_amount")).alias("value"))
    elif metric == "unique_skus":
        agg = b.groupBy("_bucket").agg(F.countDistinct("sku").alias("value"))
    elif metric in ("cancellation_rate", "rto_rate", "delivered_rate"):
        statuses = {"cancellation_rate": CANCELLED, "rto_rate": RTO, "delivered_rate": DELIVERED_LITERAL}[metric]
        agg = status_order_counts(b, ["_bucket"], {"m": statuses}).select("_bucket", status_rate("m_orders").alias("value"))
    elif metric == "cod_share":
        agg = b.groupBy("_bucket").agg(F.round(safe_pct(F.sum(_cod_row()), F.count(F.lit(1))), 2).alias("value"))
    else:
        raise ValueError(f"unknown trend metric {metric!r}")
    return finish_series(agg, grain).select("bucket", "label", F.lit(grain).alias("grain"), "value")
