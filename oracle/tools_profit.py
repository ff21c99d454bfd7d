"""Oracle SQL for T1–T19 (raw order lines), V1–V6 (vendor cost sheet) and D1–D8 (payment cycle)."""

from __future__ import annotations

from orderlens.plans import catalog as C
from orderlens.schema import HISTORY_EXTRA_TYPES, HISTORY_TYPES

from .base import ORDER_LINES, PAYMENT_CYCLE, VENDOR_COST_SHEET, money, pct, ratio

R = f"WITH ol AS ({ORDER_LINES})"
AMT = "CAST(total_amount AS DOUBLE)"


def _pctl(p: float, expr: str = AMT) -> str:
    return f"quantile_cont({expr}, {p})"


def _geo() -> str:
    parts = []
    for level, col in (("state", "state"), ("city", "pin_code")):
        per = f"""(SELECT CAST({col} AS VARCHAR) AS key, CAST(COUNT(total_amount) AS DOUBLE) AS orders,
             {money('SUM(total_amount)')} AS revenue,
             ROUND(CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount), 2) AS aov
           FROM ol WHERE {col} IS NOT NULL GROUP BY 1)"""
        for measure, name in (("orders", f"top_{level}s_by_orders"), ("revenue", f"top_{level}s_by_revenue"),
                              ("aov", f"highest_aov_{level}s")):
            parts.append(f"(SELECT '{name}' AS list, key, {measure} AS value FROM {per} p "
                         f"ORDER BY {measure} DESC, key ASC LIMIT 5)")
    return f"{R}\n" + "\nUNION ALL\n".join(parts)


def _profile() -> tuple[str, str]:
    """The profile and the values that it counts."""
    money_ = lambda c: f"CAST({c} AS DECIMAL(18,4))"
    cells = {"total_amount": money_("total_amount"), "mrp": money_("mrp"), "cost": money_("cost"), "selling_price": money_("mrp"),
             "billing_state": "state", "suborder_model_no": "model_no",
             "size": "NULLIF(regexp_extract(sku, '_([^_]*)$', 1), '')",
             "invoice_id": "CAST(order_id AS VARCHAR) || '-' || CAST(line_no AS VARCHAR)"}
    there = {"order_id", "order_date", "item_quantity", "sku", "order_status", "payment_mode", "order_type", "state",
             "marketplace", "courier", "import_warehouse_name", "line_no", "pin_code", "raw_sku", "model_no",
             "product_name", "brand", "load_ts", *cells}
    types = {c: t.simpleString() for c, t in {**HISTORY_TYPES, **HISTORY_EXTRA_TYPES}.items()}
    columns = [c for c in C.PROFILE_COLUMNS if c in there]   # the others are null in every row
    stacked = "\nUNION ALL\n".join(f"SELECT '{c}' AS col, CAST({cells.get(c, c)} AS VARCHAR) AS value FROM ol" for c in columns)
    names = ", ".join(f"('{c}', '{types[c]}')" for c in C.PROFILE_COLUMNS)
    counted = f"""{R},
s AS ({stacked}),
cnt AS (SELECT col, value, COUNT(*) AS n FROM s WHERE value IS NOT NULL GROUP BY col, value)"""
    profile = f""",
per AS (SELECT col, COUNT(*) AS distinct_count, SUM(n) AS non_null, MIN(value) AS example FROM cnt GROUP BY col),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, value ASC) AS r FROM cnt),
tops AS (SELECT col, string_agg(value || ' (' || n || ')', '; ' ORDER BY r) AS top_values FROM ranked WHERE r <= 5 GROUP BY col),
names AS (SELECT * FROM (VALUES {names}) t(col, dtype))
SELECT names.col AS "column", dtype, CAST(COALESCE(non_null, 0) AS BIGINT) AS non_null,
  COALESCE(distinct_count, 0) AS distinct_count, example, COALESCE(distinct_count, 0) <= 20 AS is_categorical, top_values,
  cnt.value, COALESCE(cnt.n, 0) AS n
FROM names LEFT JOIN per ON names.col = per.col LEFT JOIN tops ON names.col = tops.col LEFT JOIN cnt ON names.col = cnt.col"""
    return f"{counted}\n{profile}", f'{counted}\nSELECT col AS "column", value, n FROM cnt'


def _corr() -> str:
    f = C.CORR_FIELDS
    rows = []
    for a in f:
        for b in f:
            x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            rows.append(f"SELECT '{a}' AS field_a, '{b}' AS field_b, "
                        f"ROUND(covar_samp({x}, {y}) / NULLIF(stddev_samp({x}) * stddev_samp({y}), 0), 3) AS corr FROM ol")
    return f"{R}\n" + "\nUNION ALL\n".join(rows)


def queries() -> dict[str, str]:
    q = {}
    q["t1_aov"] = f"{R} SELECT {ratio('SUM(total_amount)', 'COUNT(total_amount)')} AS aov FROM ol"
    q["t2_total_revenue"] = f"{R} SELECT {money('COALESCE(SUM(total_amount), 0)')} AS total_revenue FROM ol"
    q["t3_order_count"] = f"{R} SELECT COUNT(*) AS order_count FROM ol"
    q["t4_distributions"] = f"{R}\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM ol WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ["order_status", "payment_mode", "marketplace", "state", "courier"])
    q["t5_top_localities"] = f"""{R} SELECT CAST(pin_code AS VARCHAR) AS value, COUNT(*) AS count FROM ol
WHERE pin_code IS NOT NULL GROUP BY pin_code ORDER BY count DESC, pin_code ASC LIMIT 10"""
    q["t6_average_charges"] = f"""{R} SELECT ROUND(COALESCE(AVG(CAST(mrp AS DOUBLE)), 0), 2) AS avg_mrp,
  ROUND(COALESCE(AVG(CAST(cost AS DOUBLE)), 0), 2) AS avg_cost FROM ol"""
    charges = ", ".join(f"ROUND(COALESCE(AVG(CAST({c} AS DOUBLE)), 0), 2) AS avg_{c}" for c in C.CHARGES)
    q["t6_average_order_charges"] = f"""{R},
d AS (SELECT order_id, '0.0000' AS total_discount, '0.0000' AS total_shipping_charge, '0.0000' AS total_tax FROM ol GROUP BY 1)
SELECT {charges} FROM d"""
    q["t7_conversion_rate"] = f"""{R} SELECT ROUND({pct("COUNT(CASE WHEN order_status = 'Shipped' THEN 1 END)", 'COUNT(*)')}, 2)
  AS conversion_rate FROM ol"""
    t8 = []
    for name, v in (("cod", "COD"), ("prepaid", "PrePaid")):
        t8 += [f"COUNT(CASE WHEN payment_mode = '{v}' THEN 1 END) AS {name}_count",
               f"{money(f'COALESCE(SUM(CASE WHEN payment_mode = {chr(39)}{v}{chr(39)} THEN total_amount END), 0)')} AS {name}_total_revenue",
               f"{ratio(f'SUM(CASE WHEN payment_mode = {chr(39)}{v}{chr(39)} THEN total_amount END)', f'COUNT(CASE WHEN payment_mode = {chr(39)}{v}{chr(39)} THEN total_amount END)')} AS {name}_avg_order_value"]
    q["t8_cod_vs_prepaid_exact"] = f"{R} SELECT {', '.join(t8)} FROM ol"
    q["t9_common_metrics"] = f"""{R} SELECT {ratio('SUM(total_amount)', 'COUNT(total_amount)')} AS aov,
  {money('COALESCE(SUM(total_amount), 0)')} AS total_revenue, COUNT(*) AS order_count,
  ROUND({_pctl(0.5)}, 2) AS amount_median, ROUND(stddev_samp({AMT}), 2) AS amount_std,
  ROUND({_pctl(0.25)}, 2) AS amount_q25, ROUND({_pctl(0.75)}, 2) AS amount_q75 FROM ol"""
    stats = {"count": f"COUNT({AMT})", "mean": f"AVG({AMT})", "median": _pctl(0.5), "std": f"stddev_samp({AMT})",
             "min": f"MIN({AMT})", "max": f"MAX({AMT})", "q25": _pctl(0.25), "q75": _pctl(0.75)}
    rows = {"aov": ratio("SUM(total_amount)", "COUNT(total_amount)"), "total_revenue": money("COALESCE(SUM(total_amount), 0)"),
            "order_count": "COUNT(*)", **{f"total_amount_{k}": f"ROUND(COALESCE({e}, 0), 2)" for k, e in stats.items()}}
    q["t9_common_metrics_whole"] = f"{R}\n" + "\nUNION ALL\n".join(
        [f"SELECT '{m}' AS metric, CAST(NULL AS VARCHAR) AS key, CAST({e} AS DOUBLE) AS value FROM ol" for m, e in rows.items()]
        + [f"SELECT '{c}_distribution' AS metric, CAST({c} AS VARCHAR) AS key, CAST(COUNT(*) AS DOUBLE) AS value FROM ol "
           f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("order_status", "payment_mode", "marketplace")])
    q["t10_geographic_insights"] = _geo()
    q["t11_cancelled_count"] = f"{R} SELECT COUNT(CASE WHEN order_status = 'Cancelled' THEN 1 END) AS cancel_count FROM ol"
    q["t12_statistical_summary"] = f"""{R} SELECT COUNT({AMT}) AS count, ROUND(COALESCE(AVG({AMT}), 0), 2) AS mean,
  ROUND(COALESCE({_pctl(0.5)}, 0), 2) AS median, ROUND(COALESCE(stddev_samp({AMT}), 0), 2) AS std,
  ROUND(COALESCE(MIN({AMT}), 0), 2) AS min, ROUND(COALESCE(MAX({AMT}), 0), 2) AS max,
  ROUND(COALESCE({_pctl(0.25)}, 0), 2) AS q25, ROUND(COALESCE({_pctl(0.75)}, 0), 2) AS q75 FROM ol"""
    q["t13_percentile_90"] = f"{R} SELECT ROUND(COALESCE({_pctl(0.9)}, 0), 2) AS value FROM ol"
    for key, p, op in (("t14_top_percentile_95", 0.95, ">="), ("t15_bottom_percentile_5", 0.05, "<=")):
        q[key] = f"""{R}, th AS (SELECT {_pctl(p)} AS t FROM ol)
SELECT ROUND(COALESCE(MAX(t), 0), 2) AS threshold, COUNT(CASE WHEN {AMT} {op} t THEN 1 END) AS count,
  ROUND({pct(f'COUNT(CASE WHEN {AMT} {op} t THEN 1 END)', 'COUNT(*)')}, 2) AS percentage,
  ROUND(COALESCE(SUM(CASE WHEN {AMT} {op} t THEN {AMT} END), 0), 2) AS total_value
FROM ol, th"""
    q["t16_correlation_matrix"] = _corr()
    q["t18_column_profile"], q["t18_column_values"] = _profile()
    q["t19_custom_metric"] = f"{R} SELECT {C.CUSTOM_EXPR} AS revenue_per_order FROM ol"

    V = f"WITH v AS ({VENDOR_COST_SHEET})"
    m, c = "CAST(mrp AS DOUBLE)", "CAST(final_price AS DOUBLE)"
    margin = f"(CASE WHEN {m} <> 0 THEN ({m} - {c}) / {m} * 100.0 ELSE 0.0 END)"
    markup = f"(CASE WHEN {c} <> 0 THEN ({m} - {c}) / {c} ELSE 0.0 END)"
    q["v1_v5_profit_totals"] = f"""{V}, x AS (SELECT ROUND(SUM({margin}), 2) AS margin_sum_pct, ROUND(SUM({m} - {c}), 2) AS gross_profit,
  ROUND(SUM({markup}), 4) AS markup_sum, ROUND(COALESCE(SUM({m}), 0), 2) AS selling_price,
  ROUND(COALESCE(SUM({c}), 0), 2) AS cost_price FROM v)
SELECT *, ROUND(cost_price / NULLIF(selling_price, 0) * 100.0, 2) AS cost_to_price_ratio FROM x"""
    items = f"""SELECT style_name, collection_name, brand, ROUND({c}, 2) AS cost_price, ROUND({m}, 2) AS selling_price,
  ROUND({m} - {c}, 2) AS gross_profit, ROUND({margin}, 2) AS gross_margin, ROUND({markup}, 4) AS markup,
  ROUND(ROUND({markup}, 4) * 100.0, 2) AS markup_percent,
  ROUND(ROUND({c}, 2) / NULLIF(ROUND({m}, 2), 0) * 100.0, 2) AS cost_to_price_ratio FROM v"""
    q["v6_profit_items"] = f"{V} {items}"
    q["v6_profit_by_group"] = f"""{V}, it AS ({items})
SELECT brand, COUNT(*) AS count, ROUND(COALESCE(AVG(gross_margin), 0), 2) AS avg_gross_margin,
  ROUND(COALESCE(AVG(markup_percent), 0), 2) AS avg_markup_percent, ROUND(SUM(gross_profit), 2) AS total_gross_profit
FROM it GROUP BY brand"""

    P = f"WITH pc AS ({PAYMENT_CYCLE})"
    mg, cy, cd = "CAST(margin AS DOUBLE)", "CAST(payment_cycle AS DOUBLE)", "CAST(cd AS DOUBLE)"
    q["d_payment_cycle_metrics"] = f"""{P} SELECT ROUND(AVG({mg}), 2) AS avg_margin, ROUND(AVG({mg}), 2) AS weighted_avg_margin,
  ROUND(AVG(CASE WHEN {cy} > 0 THEN {mg} / {cy} END), 4) AS margin_per_payment_day,
  ROUND(SUM({mg}), 2) AS total_margin_exposure,
  ROUND(AVG(CASE WHEN {cy} > 0 THEN (100 - {mg}) / {cy} END), 4) AS cycle_efficiency_score,
  COUNT(CASE WHEN {cy} >= 0 AND {cy} < 15 THEN 1 END) AS very_short_cycle_0_15,
  COUNT(CASE WHEN {cy} >= 15 AND {cy} < 30 THEN 1 END) AS short_cycle_15_30,
  COUNT(CASE WHEN {cy} >= 30 AND {cy} < 45 THEN 1 END) AS medium_cycle_30_45,
  COUNT(CASE WHEN {cy} >= 45 THEN 1 END) AS long_cycle_45plus,
  ROUND(COALESCE(SUM({cd}), 0), 2) AS cd_sum, ROUND(COALESCE(AVG({cd}), 0), 2) AS cd_mean,
  ROUND(COALESCE(MAX({cd}), 0), 2) AS cd_max, ROUND(COALESCE(MIN({cd}), 0), 2) AS cd_min, COUNT({cd}) AS cd_count FROM pc"""
    q["d2_weighted_avg_margin_by_cd"] = f"""{P} SELECT ROUND(SUM({mg} * {cd}) / NULLIF(SUM({cd}), 0), 2) AS weighted_avg_margin FROM pc"""
    q["d5_high_risk_distributors"] = f"""{P} SELECT party_name, margin, payment_cycle, cd,
  ROUND({mg} / 100.0 * ({cy} / 45.0), 3) AS risk_score FROM pc WHERE {mg} > 30 AND {cy} > 45"""
    return q
