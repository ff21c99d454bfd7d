"""Oracle SQL for K0–K12 and KT1–KT9."""

from __future__ import annotations

from datetime import datetime

from orderlens.plans import catalog as C
from orderlens.plans.request import HistoryRequest, quarter_windows, trailing_windows
from orderlens.functions.timebuckets import grain_from_window

from .base import bucket, growth, history, label, money, pct, ratio

FULL = (f"{C.FULL_START} 00:00:00", f"{C.FULL_END} 23:59:59")


def _cnt_status(statuses: str) -> str:
    return f"COUNT(DISTINCT CASE WHEN order_status IN ({statuses}) THEN order_id END)"


def rate_orders(status: str) -> str:
    """Distinct orders with the status ÷ distinct orders, %, 2 places."""
    return f"ROUND({pct(_cnt_status(f"'{status}'"), 'COUNT(DISTINCT order_id)')}, 2)"


def rate_rows(col: str, value: str) -> str:
    """Rows with ``col = value`` ÷ rows, %, 2 places."""
    return f"ROUND({pct(f"SUM(CASE WHEN {col} = '{value}' THEN 1 ELSE 0 END)", 'COUNT(*)')}, 2)"


def _card(expr: str) -> str:
    return f"WITH {history(*FULL)} SELECT {expr} AS value FROM e"


K0 = f"""WITH {history(*FULL)}
SELECT COUNT(DISTINCT order_id) AS total_orders,
  CAST(COALESCE(SUM(item_quantity), 0) AS BIGINT) AS units_sold,
  {money('COALESCE(SUM(total_amount), 0)')} AS gross_revenue,
  {ratio('COALESCE(SUM(total_amount), 0)', 'COUNT(DISTINCT order_id)')} AS aov,
  COUNT(DISTINCT sku) AS unique_skus,
  {rate_orders("Cancelled")} AS cancellation_rate,
  {rate_orders("RTO")} AS return_rate,
  {rate_rows("payment_mode", "COD")} AS cod_share,
  {rate_orders("Delivered")} AS delivered_rate
FROM e"""


def _comparison(cur, prev) -> str:
    (cs, ce), (ps, pe) = cur, prev
    lo, hi = f"{min(cs, ps)} 00:00:00", f"{max(ce, pe)} 23:59:59"
    return f"""WITH {history(lo, hi)},
w AS (
  SELECT 'current' AS win, order_id, total_amount, item_quantity FROM e
    WHERE order_date BETWEEN TIMESTAMP '{cs} 00:00:00' AND TIMESTAMP '{ce} 23:59:59'
  UNION ALL
  SELECT 'previous' AS win, order_id, total_amount, item_quantity FROM e
    WHERE order_date BETWEEN TIMESTAMP '{ps} 00:00:00' AND TIMESTAMP '{pe} 23:59:59'),
a AS (SELECT win, COUNT(DISTINCT order_id) AS o, SUM(total_amount) AS r, SUM(item_quantity) AS u FROM w GROUP BY win),
x AS (SELECT
    COALESCE(MAX(CASE WHEN win = 'current' THEN o END), 0) AS co,
    COALESCE(MAX(CASE WHEN win = 'current' THEN r END), 0) AS cr,
    CAST(COALESCE(MAX(CASE WHEN win = 'current' THEN u END), 0) AS BIGINT) AS cu,
    COALESCE(MAX(CASE WHEN win = 'previous' THEN o END), 0) AS po,
    COALESCE(MAX(CASE WHEN win = 'previous' THEN r END), 0) AS pr,
    CAST(COALESCE(MAX(CASE WHEN win = 'previous' THEN u END), 0) AS BIGINT) AS pu
  FROM a),
y AS (SELECT *, COALESCE(CAST(cr AS DOUBLE) / NULLIF(CAST(co AS DOUBLE), 0), 0.0) AS ca,
                COALESCE(CAST(pr AS DOUBLE) / NULLIF(CAST(po AS DOUBLE), 0), 0.0) AS pa FROM x)
SELECT '{cs}' AS cur_start, '{ce}' AS cur_end, '{ps}' AS prev_start, '{pe}' AS prev_end,
  co AS cur_orders, {money('cr')} AS cur_revenue, cu AS cur_units, ROUND(ca, 2) AS cur_aov,
  po AS prev_orders, {money('pr')} AS prev_revenue, pu AS prev_units, ROUND(pa, 2) AS prev_aov,
  ROUND({growth('co', 'po')}, 2) AS orders_pct,
  ROUND({growth('CAST(cr AS DOUBLE)', 'CAST(pr AS DOUBLE)')}, 2) AS revenue_pct,
  ROUND({growth('cu', 'pu')}, 2) AS units_pct,
  ROUND({growth('ca', 'pa')}, 2) AS aov_pct
FROM y"""


def _trend(metric: str, start: str, end: str) -> str:
    req = HistoryRequest(start, end)
    grain = grain_from_window(req.start, req.end)
    value = {
        "total_orders": "COUNT(DISTINCT order_id)",
        "units_sold": "CAST(SUM(item_quantity) AS BIGINT)",
        "gross_revenue": money("SUM(total_amount)"),
        "aov": ratio("SUM(total_amount)", "COUNT(total_amount)"),
        "unique_skus": "COUNT(DISTINCT sku)",
        "cancellation_rate": rate_orders("Cancelled"),
        "rto_rate": rate_orders("RTO"),
        "cod_share": rate_rows("payment_mode", "COD"),
        "delivered_rate": rate_orders("Delivered"),
    }[metric]
    s, e = req.start.isoformat(sep=" "), req.end.isoformat(sep=" ")
    return f"""WITH {history(s, e)}, bk AS (SELECT *, {bucket(grain)} AS b FROM e)
SELECT strftime(b, '%Y-%m-%d') AS bucket, {label(grain)} AS label, '{grain}' AS grain, {value} AS value
FROM bk GROUP BY b"""


def queries() -> dict[str, str]:
    end = datetime.fromisoformat(f"{C.CARD_END} 23:59:59")
    c30 = trailing_windows(end, 30)
    c7 = trailing_windows(end, 7)
    cq = quarter_windows(end)
    out = {
        "k0_kpi_bundle": K0,
        "k1_total_orders": _card("COUNT(DISTINCT order_id)"),
        "k2_units_sold": _card("CAST(COALESCE(SUM(item_quantity), 0) AS BIGINT)"),
        "k3_gross_revenue": _card(money("COALESCE(SUM(total_amount), 0)")),
        "k4_aov_row_mean": _card(ratio("SUM(total_amount)", "COUNT(total_amount)")),
        "k5_unique_skus": _card("COUNT(DISTINCT sku)"),
        "k6_cancellation_rate": _card(rate_orders("Cancelled")),
        "k7_return_rate": _card(rate_orders("RTO")),
        "k8_cod_share": _card(rate_rows("payment_mode", "COD")),
        "k9_delivered_rate": _card(rate_rows("order_status", "Shipped")),
        "k10_comparison_30d": _comparison((c30[0], c30[1]), (c30[2], c30[3])),
        "k11_comparison_7d": _comparison((c7[0], c7[1]), (c7[2], c7[3])),
        "k12_comparison_quarter": _comparison((cq[0], cq[1]), (cq[2], cq[3])),
    }
    metrics = ["total_orders", "units_sold", "gross_revenue", "aov", "unique_skus",
               "cancellation_rate", "rto_rate", "cod_share", "delivered_rate"]
    for i, m in enumerate(metrics, start=1):
        out[f"kt{i}_{m}_trend"] = _trend(m, C.FULL_START, C.FULL_END)
    out["kt1_total_orders_weekly_trend"] = _trend("total_orders", "2000-01-01", "2000-05-31")
    out["kt3_gross_revenue_daily_trend"] = _trend("gross_revenue", "2001-01-01", "2001-01-31")
    return out
