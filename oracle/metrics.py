"""Oracle SQL for M1–M26."""

from __future__ import annotations

from .base import history, money, pct, ratio
from .kpis import FULL

H = f"WITH {history(*FULL)}"
# value-based unit column: item_quantity when its global sum is positive (the
# other quantity columns are absent from the fixture, i.e. null → 0)
UNITS = "(CASE WHEN (SELECT COALESCE(SUM(item_quantity), 0) FROM e) > 0 THEN COALESCE(item_quantity, 0) ELSE 0 END)"


def clean(col: str) -> str:
    return f"COALESCE(NULLIF(TRIM({col}), ''), 'UNKNOWN')"


def _sku_base(units: str) -> str:
    return f"""sk AS (SELECT {clean('sku')} AS k, COUNT(DISTINCT order_id) AS order_count, SUM(total_amount) AS rev,
    SUM({units}) AS units, SUM(item_quantity) AS iq, MIN(suborder_model_no) AS style
  FROM e GROUP BY 1)"""


def _dim_rates(col: str, name: str, extra: str = "") -> str:
    return f"""SELECT {clean(col)} AS {name}, COUNT(DISTINCT order_id) AS o,
    COUNT(DISTINCT CASE WHEN order_status = 'Cancelled' THEN order_id END) AS c,
    COUNT(DISTINCT CASE WHEN order_status = 'RTO' THEN order_id END) AS r,
    COUNT(DISTINCT CASE WHEN order_status IN ('Delivered', 'Manifest Scanned') THEN order_id END) AS d{extra}
  FROM e GROUP BY 1"""


def _span() -> str:
    return "CAST(floor((epoch(MAX(order_date)) - epoch(MIN(order_date))) / 86400) + 1 AS BIGINT)"


PAY_MEMBER = """CASE WHEN NULLIF(TRIM(payment_mode), '') IS NULL THEN NULL
  WHEN UPPER(TRIM(payment_mode)) = 'COD' THEN 'COD' WHEN UPPER(TRIM(payment_mode)) = 'PREPAID' THEN 'PrePaid'
  ELSE TRIM(payment_mode) END"""
TYPE_MEMBER = """CASE WHEN NULLIF(TRIM(order_type), '') IS NULL THEN NULL
  WHEN UPPER(TRIM(order_type)) = 'B2B' THEN 'B2B' WHEN UPPER(TRIM(order_type)) = 'B2C' THEN 'B2C'
  WHEN UPPER(TRIM(order_type)) = 'B2B2C' THEN 'B2B2C' ELSE TRIM(order_type) END"""


def _mix(member: str, name: str, units: bool) -> str:
    extra = f", CAST(SUM({UNITS}) AS BIGINT) AS units" if units else ""
    last = "units" if units else f"ROUND({pct('c', 'o')}, 2) AS cancellation_rate"
    return f"""{H},
g AS (SELECT {member} AS k, COUNT(DISTINCT order_id) AS o, SUM(total_amount) AS rev,
    COUNT(DISTINCT CASE WHEN order_status = 'Cancelled' THEN order_id END) AS c{extra}
  FROM e GROUP BY 1),
x AS (SELECT * FROM g WHERE k IS NOT NULL),
t AS (SELECT SUM(o) AS to_, SUM(rev) AS tr FROM x)
SELECT k AS {name}, o AS order_count, {money('rev')} AS revenue, {ratio('rev', 'o')} AS aov, {last},
  ROUND({pct('o', 'to_')}, 2) AS order_pct, ROUND({pct('rev', 'tr')}, 2) AS revenue_pct
FROM x, t"""


def queries() -> dict[str, str]:
    q = {}
    q["m1_sku_diversity_index"] = f"""{H}
SELECT {ratio('COUNT(DISTINCT sku)', 'COUNT(DISTINCT order_id)', 4)} AS value, COUNT(DISTINCT sku) AS unique_skus,
  COUNT(DISTINCT order_id) AS total_orders FROM e"""
    q["m2_top_skus_by_revenue"] = f"""{H}, {_sku_base('0')}
SELECT k AS sku, COALESCE(style, '') AS style_name, {money('rev')} AS revenue, order_count,
  CAST(CASE WHEN COALESCE(iq, 0) > 0 THEN iq ELSE 0 END AS BIGINT) AS units, {ratio('rev', 'order_count')} AS aov
FROM sk ORDER BY rev DESC, k ASC LIMIT 5"""
    q["m3_top_skus_by_units"] = f"""{H}, {_sku_base(UNITS)}
SELECT k AS sku, COALESCE(style, '') AS style_name, CAST(units AS BIGINT) AS units, order_count,
  {money('rev')} AS revenue, {ratio('rev', 'order_count')} AS aov
FROM sk ORDER BY units DESC, k ASC LIMIT 5"""
    q["m4_average_units_per_order"] = f"""{H}
SELECT {ratio('COALESCE(SUM(item_quantity), 0)', 'COUNT(DISTINCT order_id)')} AS value,
  CAST(COALESCE(SUM(item_quantity), 0) AS BIGINT) AS total_units, COUNT(DISTINCT order_id) AS total_orders FROM e"""
    q["m5_size_mix_distribution"] = f"""{H},
g AS (SELECT size_bucket AS size, CAST(SUM({UNITS}) AS BIGINT) AS units FROM e GROUP BY 1),
t AS (SELECT SUM(units) AS tot FROM g)
SELECT size, units, ROUND({pct('units', 'tot')}, 2) AS percentage, CAST(tot AS BIGINT) AS total_units FROM g, t"""
    q["m6_sku_performance_matrix"] = f"""{H}, {_sku_base(UNITS)}
SELECT k AS sku, COALESCE(style, '') AS style_name, {money('rev')} AS revenue, CAST(units AS BIGINT) AS units,
  order_count, {ratio('rev', 'units')} AS revenue_per_unit, {ratio('units', 'order_count')} AS units_per_order
FROM sk ORDER BY rev DESC, k ASC LIMIT 20"""
    fulfil = f"""{H}
SELECT ROUND({pct("COUNT(CASE WHEN order_status IN ('Manifest Scanned', 'Shipped') THEN 1 END)", 'COUNT(DISTINCT order_id)')}, 2) AS value,
  COUNT(CASE WHEN order_status IN ('Manifest Scanned', 'Shipped') THEN 1 END) AS fulfilled_orders,
  COUNT(DISTINCT order_id) AS total_orders FROM e"""
    q["m7_fulfillment_rate"] = fulfil
    q["m20_overall_fulfillment_rate"] = fulfil
    q["m8_order_value_distribution"] = f"""{H}
SELECT ROUND(quantile_cont(CAST(total_amount AS DOUBLE), 0.25), 2) AS p25,
  ROUND(quantile_cont(CAST(total_amount AS DOUBLE), 0.5), 2) AS median,
  ROUND(quantile_cont(CAST(total_amount AS DOUBLE), 0.75), 2) AS p75,
  {money('MIN(total_amount)')} AS min, {money('MAX(total_amount)')} AS max,
  {ratio('SUM(total_amount)', 'COUNT(total_amount)')} AS mean,
  ROUND(stddev_samp(CAST(total_amount AS DOUBLE)), 2) AS std_dev FROM e"""
    q["m9_order_velocity"] = f"""{H},
x AS (SELECT {_span()} AS period_days, COUNT(DISTINCT order_id) AS total_orders FROM e),
y AS (SELECT *, COALESCE(CAST(total_orders AS DOUBLE) / NULLIF(CAST(period_days AS DOUBLE), 0), 0.0) AS d FROM x)
SELECT ROUND(d, 2) AS daily, ROUND(d * 7, 2) AS weekly, ROUND(d * 30, 2) AS monthly, period_days, total_orders FROM y"""
    q["m10_units_velocity"] = f"""{H},
x AS (SELECT {_span()} AS period_days, CAST(COALESCE(SUM(item_quantity), 0) AS BIGINT) AS total_units FROM e)
SELECT {ratio('total_units', 'period_days')} AS value, total_units, period_days FROM x"""
    st = f"st AS (SELECT {clean('state')} AS k, SUM(total_amount) AS rev, COUNT(DISTINCT order_id) AS order_count FROM e GROUP BY 1)"
    q["m11_top_states_by_revenue"] = f"""{H}, {st},
top AS (SELECT * FROM st ORDER BY rev DESC, k ASC LIMIT 5), t AS (SELECT SUM(rev) AS tot FROM top)
SELECT k AS state, {money('rev')} AS revenue, order_count, ROUND({pct('rev', 'tot')}, 2) AS revenue_share,
  {ratio('rev', 'order_count')} AS aov FROM top, t"""
    q["m12_top_states_by_orders"] = f"""{H}, {st},
top AS (SELECT * FROM st ORDER BY order_count DESC, k ASC LIMIT 5), t AS (SELECT SUM(order_count) AS tot FROM top)
SELECT k AS state, order_count, ROUND({pct('order_count', 'tot')}, 2) AS order_share, {money('rev')} AS revenue,
  {ratio('rev', 'order_count')} AS aov FROM top, t"""
    q["m13_geographic_revenue_concentration"] = f"""{H}, {st},
top AS (SELECT * FROM st ORDER BY rev DESC, k ASC LIMIT 3),
t AS (SELECT (SELECT SUM(rev) FROM st) AS tot, (SELECT SUM(rev) FROM top) AS t3),
c AS (SELECT ROUND({pct('t3', 'tot')}, 2) AS conc, tot FROM t)
SELECT k AS state, {money('rev')} AS revenue, ROUND({pct('rev', 'tot')}, 2) AS revenue_pct, conc AS concentration_pct,
  CASE WHEN conc > 70 THEN 'HIGH' WHEN conc > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM top, c"""
    q["m14_state_cancellation_rates"] = f"""{H}, g AS ({_dim_rates('state', 'state')})
SELECT state, o AS total_orders, ROUND({pct('c', 'o')}, 2) AS cancellation_rate, ROUND({pct('r', 'o')}, 2) AS rto_rate,
  ROUND({pct('c', 'o')} + {pct('r', 'o')}, 2) AS issue_rate FROM g"""
    q["m15_marketplace_performance"] = f"""{H}, g AS ({_dim_rates('marketplace', 'marketplace', ', SUM(total_amount) AS rev')})
SELECT marketplace, {money('rev')} AS revenue, o AS order_count, {ratio('rev', 'o')} AS aov,
  ROUND({pct('c', 'o')}, 2) AS cancellation_rate FROM g"""
    q["m16_courier_performance"] = f"""{H}, g AS ({_dim_rates('courier', 'courier')})
SELECT courier, o AS order_count, ROUND({pct('d', 'o')}, 2) AS delivery_rate, ROUND({pct('c', 'o')}, 2) AS cancellation_rate,
  ROUND({pct('r', 'o')}, 2) AS rto_rate FROM g"""
    q["m17_warehouse_efficiency"] = f"""{H},
g AS (SELECT {clean('import_warehouse_name')} AS warehouse, COUNT(DISTINCT order_id) AS order_count, SUM(total_amount) AS rev
  FROM e GROUP BY 1)
SELECT warehouse, order_count, {money('rev')} AS revenue, {ratio('rev', 'order_count')} AS aov FROM g"""
    q["m18_payment_mode_breakdown"] = _mix(PAY_MEMBER, "payment_mode", False)
    q["m19_order_type_breakdown"] = _mix(TYPE_MEMBER, "order_type", True)
    q["m21_overall_issue_rate"] = f"""{H},
x AS (SELECT COUNT(DISTINCT CASE WHEN order_status = 'Cancelled' THEN order_id END) AS c,
  COUNT(DISTINCT CASE WHEN order_status = 'RTO' THEN order_id END) AS r, COUNT(DISTINCT order_id) AS o FROM e)
SELECT ROUND({pct('c + r', 'o')}, 2) AS value, c AS cancelled_orders, r AS rto_orders, c + r AS total_issue_orders,
  o AS total_orders FROM x"""
    q["m22_payment_risk_analysis"] = f"""{H},
x AS (SELECT COUNT(DISTINCT CASE WHEN cod THEN order_id END) AS co,
    COUNT(DISTINCT CASE WHEN cod AND order_status = 'Cancelled' THEN order_id END) AS cc,
    COUNT(DISTINCT CASE WHEN NOT cod THEN order_id END) AS po,
    COUNT(DISTINCT CASE WHEN NOT cod AND order_status = 'Cancelled' THEN order_id END) AS pc
  FROM (SELECT *, COALESCE(({PAY_MEMBER}) = 'COD', FALSE) AS cod FROM e)),
y AS (SELECT *, {pct('cc', 'co')} AS cr, {pct('pc', 'po')} AS pr FROM x)
SELECT ROUND(cr, 2) AS cod_cancellation_rate, ROUND(pr, 2) AS prepaid_cancellation_rate, ROUND(cr - pr, 2) AS risk_increase_pp,
  co AS cod_order_count, po AS prepaid_order_count,
  CASE WHEN cr - pr > 15 THEN 'CRITICAL' WHEN cr - pr > 10 THEN 'HIGH' WHEN cr - pr > 5 THEN 'MODERATE' ELSE 'LOW' END AS risk_level
FROM y"""
    q["m23_marketplace_risk_score"] = f"""{H}, g AS ({_dim_rates('marketplace', 'marketplace')}),
y AS (SELECT *, {pct('c', 'o')} AS cr, {pct('r', 'o')} AS rr FROM g)
SELECT marketplace, o AS order_count, ROUND(cr, 2) AS cancellation_rate, ROUND(rr, 2) AS rto_rate,
  ROUND(cr + rr, 2) AS risk_score,
  CASE WHEN cr + rr > 30 THEN 'CRITICAL' WHEN cr + rr > 20 THEN 'HIGH' WHEN cr + rr > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM y"""
    q["m24_revenue_per_channel"] = f"""{H}
SELECT 'marketplace' AS dimension, {clean('marketplace')} AS key, {money('SUM(total_amount)')} AS revenue FROM e GROUP BY 2
UNION ALL
SELECT 'courier' AS dimension, {clean('courier')} AS key, {money('SUM(total_amount)')} AS revenue FROM e GROUP BY 2
UNION ALL
SELECT 'warehouse' AS dimension, {clean('import_warehouse_name')} AS key, {money('SUM(total_amount)')} AS revenue FROM e GROUP BY 2"""
    q["m25_seasonal_trends"] = f"""{H}
SELECT strftime(order_date, '%Y-%m') AS year_month, COUNT(DISTINCT order_id) AS order_count,
  {money('SUM(total_amount)')} AS revenue, {ratio('SUM(total_amount)', 'COUNT(DISTINCT order_id)')} AS aov
FROM e GROUP BY 1"""
    q["m26_product_payment_correlation"] = f"""{H},
x AS (SELECT size_bucket, COALESCE(({PAY_MEMBER}) = 'COD', FALSE) AS cod, {UNITS} AS u FROM e),
g AS (SELECT size_bucket AS size, CAST(SUM(CASE WHEN cod THEN u ELSE 0 END) AS BIGINT) AS cod_units,
    CAST(SUM(CASE WHEN NOT cod THEN u ELSE 0 END) AS BIGINT) AS prepaid_units FROM x GROUP BY 1)
SELECT size, cod_units, ROUND({pct('cod_units', 'cod_units + prepaid_units')}, 2) AS cod_pct, prepaid_units,
  ROUND({pct('prepaid_units', 'cod_units + prepaid_units')}, 2) AS prepaid_pct, cod_units + prepaid_units AS total_units
FROM g WHERE cod_units + prepaid_units > 0"""
    return q
