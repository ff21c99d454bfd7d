"""Oracle SQL for the batch bundle B1–B13 (long form: category, metric, key, value)."""

from __future__ import annotations

from . import kpis, metrics
from .base import history, money, pct, ratio
from .kpis import FULL

H = f"WITH {history(*FULL)}"
CLEAN = metrics.clean


def _wrap(sql: str, category: str, metric: str, key: str | None, value: str) -> str:
    k = "CAST(NULL AS VARCHAR)" if key is None else f"CAST({key} AS VARCHAR)"
    return f"SELECT '{category}' AS category, '{metric}' AS metric, {k} AS key, CAST({value} AS DOUBLE) AS value FROM ({sql}) t"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def primary() -> str:
    cols = ["total_orders", "units_sold", "gross_revenue", "aov", "unique_skus", "cancellation_rate", "return_rate",
            "cod_share", "delivered_rate"]
    parts = [_wrap(kpis.K0, "primary", c, None, c) for c in cols]
    series = f"""{H},
m AS (SELECT strftime(CAST(date_trunc('month', order_date) AS DATE), '%Y-%m-%d') AS bucket, COUNT(DISTINCT order_id) AS orders,
        {money('SUM(total_amount)')} AS revenue FROM e GROUP BY 1),
g AS (SELECT *, LAG(CAST(orders AS DOUBLE)) OVER (ORDER BY bucket) AS po, LAG(revenue) OVER (ORDER BY bucket) AS pr FROM m)
SELECT bucket, orders, revenue,
  CASE WHEN po IS NULL THEN NULL WHEN po = 0 THEN (CASE WHEN orders = 0 THEN 0.0 ELSE NULL END)
       ELSE ROUND((orders - po) / po * 100.0, 2) END AS orders_growth,
  CASE WHEN pr IS NULL THEN NULL WHEN pr = 0 THEN (CASE WHEN revenue = 0 THEN 0.0 ELSE NULL END)
       ELSE ROUND((revenue - pr) / pr * 100.0, 2) END AS revenue_growth
FROM g"""
    for m in ("orders", "revenue", "orders_growth", "revenue_growth"):
        parts.append(_wrap(series, "primary", f"{m}_series", "bucket", m))
    return _union(parts)


def product() -> str:
    q = metrics.queries()
    perf10 = q["m6_sku_performance_matrix"].replace("LIMIT 20", "LIMIT 10")
    sizes = f"""{H}, s AS (SELECT size, COUNT(*) AS n FROM e WHERE size IS NOT NULL GROUP BY size), t AS (SELECT SUM(n) AS tot FROM s)
SELECT size, n, ROUND({pct('n', 'tot')}, 2) AS p FROM s, t"""
    return _union([
        _wrap(q["m1_sku_diversity_index"], "product", "sku_diversity_index", None, "value"),
        _wrap(q["m4_average_units_per_order"], "product", "avg_units_per_order", None, "value"),
        _wrap(q["m2_top_skus_by_revenue"], "product", "top_skus_by_revenue", "sku", "revenue"),
        _wrap(q["m3_top_skus_by_units"], "product", "top_skus_by_units", "sku", "units"),
        _wrap(perf10, "product", "sku_performance_revenue", "sku", "revenue"),
        _wrap(sizes, "product", "size_mix_count", "size", "n"),
        _wrap(sizes, "product", "size_mix_pct", "size", "p")])


def sku_details() -> str:
    """The rows of the three SKU lists with all their columns."""
    q, parts = metrics.queries(), []
    lists = [("top_skus_by_revenue", q["m2_top_skus_by_revenue"], "revenue"), ("top_skus_by_units", q["m3_top_skus_by_units"], "units"),
             ("sku_performance", q["m6_sku_performance_matrix"].replace("LIMIT 20", "LIMIT 10"), "revenue")]
    for name, sql, by in lists:
        more = ["aov"] if name.startswith("top") else ["revenue_per_unit", "units_per_order"]
        cols = ", ".join(f"CAST({c if c in more else 'NULL'} AS DOUBLE) AS {c}" for c in ("aov", "revenue_per_unit", "units_per_order"))
        parts.append(f"SELECT '{name}' AS list, CAST(ROW_NUMBER() OVER (ORDER BY {by} DESC, sku) AS INTEGER) AS rank, sku, style_name, "
                     f"revenue, order_count, units, {cols} FROM ({sql}) t")
    return _union(parts)


def _row_rate(statuses: str) -> str:
    return f"{H} SELECT ROUND({pct(f'COUNT(CASE WHEN order_status IN ({statuses}) THEN 1 END)', 'COUNT(*)')}, 2) AS value FROM e"


def performance() -> str:
    q = metrics.queries()
    dist = f"""{H} SELECT {money('MIN(total_amount)')} AS mn, {money('MAX(total_amount)')} AS mx,
  {ratio('SUM(total_amount)', 'COUNT(total_amount)')} AS mean, ROUND(quantile_cont(CAST(total_amount AS DOUBLE), 0.5), 2) AS median,
  ROUND(stddev_samp(CAST(total_amount AS DOUBLE)), 2) AS std FROM e"""
    return _union([
        _wrap(_row_rate("'Shipped', 'Returned'"), "performance", "fulfillment_rate", None, "value"),
        _wrap(dist, "performance", "order_value_min", None, "mn"), _wrap(dist, "performance", "order_value_max", None, "mx"),
        _wrap(dist, "performance", "order_value_mean", None, "mean"),
        _wrap(dist, "performance", "order_value_median", None, "median"),
        _wrap(dist, "performance", "order_value_std", None, "std"),
        _wrap(q["m9_order_velocity"], "performance", "order_velocity_daily", None, "daily"),
        _wrap(q["m10_units_velocity"], "performance", "units_velocity", None, "value")])


def geographic() -> str:
    q = metrics.queries()
    per = f"per AS (SELECT {CLEAN('state')} AS k, SUM(total_amount) AS rev, COUNT(*) AS n FROM e GROUP BY 1)"
    top_rev = f"""{H}, {per}, t AS (SELECT * FROM per ORDER BY rev DESC, k ASC LIMIT 10), s AS (SELECT SUM(rev) AS tot FROM t)
SELECT k, {money('rev')} AS v, ROUND({pct('rev', 'tot')}, 2) AS p FROM t, s"""
    top_rows = f"""{H}, {per}, t AS (SELECT * FROM per ORDER BY n DESC, k ASC LIMIT 10), s AS (SELECT SUM(n) AS tot FROM t)
SELECT k, n, ROUND({pct('n', 'tot')}, 2) AS p FROM t, s"""
    rates = f"""{H}, r AS (SELECT {CLEAN('state')} AS k,
    ROUND({pct("COUNT(DISTINCT CASE WHEN order_status = 'Cancelled' THEN order_id END)", 'COUNT(DISTINCT order_id)')}, 2) AS rate
  FROM e GROUP BY 1)
SELECT k, rate FROM r WHERE rate > 0 ORDER BY rate DESC, k ASC LIMIT 10"""
    conc = f"SELECT DISTINCT concentration_pct FROM ({q['m13_geographic_revenue_concentration']}) c"
    return _union([
        _wrap(top_rev, "geographic", "top_states_by_revenue", "k", "v"),
        _wrap(top_rev, "geographic", "top_states_by_revenue_pct", "k", "p"),
        _wrap(top_rows, "geographic", "top_states_by_rows", "k", "n"),
        _wrap(top_rows, "geographic", "top_states_by_rows_pct", "k", "p"),
        _wrap(conc, "geographic", "geo_concentration", None, "concentration_pct"),
        _wrap(rates, "geographic", "state_cancellation_rate", "k", "rate")])


def channel() -> str:
    parts = []
    for dim, col in (("marketplace", "marketplace"), ("courier", "courier"), ("warehouse", "import_warehouse_name")):
        g = f"""{H} SELECT {CLEAN(col)} AS k, COUNT(DISTINCT order_id) AS orders, {money('SUM(total_amount)')} AS revenue,
  {ratio('SUM(total_amount)', 'COUNT(DISTINCT order_id)')} AS aov FROM e GROUP BY 1"""
        for m in ("orders", "revenue", "aov"):
            parts.append(_wrap(g, "channel", f"{dim}_{m}", "k", m))
    for col, cat, name in (("payment_mode", "channel", "payment_mode_share"), ("order_type", "order_type", "order_type_share")):
        s = f"""{H}, c AS (SELECT {col} AS k, COUNT(*) AS n FROM e WHERE {col} IS NOT NULL GROUP BY 1), t AS (SELECT SUM(n) AS tot FROM c)
SELECT k, ROUND({pct('n', 'tot')}, 2) AS p FROM c, t"""
        parts.append(_wrap(s, cat, name, "k", "p"))
    return _union(parts)


def quality() -> str:
    risk = f"""{H} SELECT {CLEAN('marketplace')} AS k,
  ROUND({pct("COUNT(DISTINCT CASE WHEN order_status IN ('Cancelled', 'RTO') THEN order_id END)", 'COUNT(DISTINCT order_id)')}, 2) AS s
FROM e GROUP BY 1"""
    return _union([_wrap(_row_rate("'Shipped', 'Returned'"), "quality", "overall_fulfillment", None, "value"),
                   _wrap(_row_rate("'Cancelled', 'Returned'"), "quality", "overall_issue_rate", None, "value"),
                   _wrap(risk, "quality", "marketplace_risk_score", "k", "s")])


def advanced() -> str:
    mp = f"{H} SELECT {CLEAN('marketplace')} AS k, {money('SUM(total_amount)')} AS v FROM e GROUP BY 1"
    mo = f"""{H} SELECT strftime(order_date, '%Y-%m') AS k, COUNT(DISTINCT order_id) AS o, {money('SUM(total_amount)')} AS r
FROM e GROUP BY 1"""
    return _union([_wrap(mp, "advanced", "revenue_per_marketplace", "k", "v"), _wrap(mo, "advanced", "monthly_orders", "k", "o"),
                   _wrap(mo, "advanced", "monthly_revenue", "k", "r")])


def queries() -> dict[str, str]:
    parts = {"b2_primary_kpis": primary(), "b3_b4_product_metrics": product(), "b5_b6_performance_metrics": performance(),
             "b7_b8_geographic_metrics": geographic(), "b9_b10_channel_metrics": channel(),
             "b11_b12_quality_metrics": quality(), "b13_advanced_metrics": advanced()}
    parts["b1_batch_all_metrics"] = _union(list(parts.values()))
    return {**parts, "b4_sku_detail_rows": sku_details()}
