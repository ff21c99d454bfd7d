"""Oracle SQL for P1–P6 (comparisons) and G1–G15 (charts)."""

from __future__ import annotations

from datetime import datetime

from orderlens.plans import catalog as C
from orderlens.plans.request import HistoryRequest, previous_window, trailing_windows

from .base import growth, history, money, pct, ratio
from .kpis import FULL, rate_orders

SKU = "canonical_sku_normalized"


def _seg_cols(seg: str, rto: bool, units: bool) -> str:
    o = f"COUNT(DISTINCT CASE WHEN seg = '{seg}' THEN order_id END)"
    amt = f"COALESCE(SUM(CASE WHEN seg = '{seg}' THEN total_amount END), 0)"
    cols = [f"{o} AS {seg}_order_count"]
    if units:
        units_sum = f"COALESCE(SUM(CASE WHEN seg = '{seg}' THEN item_quantity END), 0)"
        cols.append(f"{ratio(units_sum, o)} AS {seg}_units_per_order")
    else:
        cols.append(f"{money(amt)} AS {seg}_revenue")
    cols.append(f"{ratio(amt, o)} AS {seg}_aov")
    c = f"COUNT(DISTINCT CASE WHEN seg = '{seg}' AND order_status = 'Cancelled' THEN order_id END)"
    cols.append(f"ROUND({pct(c, o)}, 2) AS {seg}_cancellation_rate")
    if rto:
        r = f"COUNT(DISTINCT CASE WHEN seg = '{seg}' AND order_status = 'RTO' THEN order_id END)"
        cols.append(f"ROUND({pct(r, o)}, 2) AS {seg}_rto_rate")
    return ",\n  ".join(cols)


P1 = f"""WITH {history(*FULL)},
s AS (SELECT CASE WHEN payment_mode = 'COD' THEN 'cod' ELSE 'prepaid' END AS seg, * FROM e)
SELECT {_seg_cols('cod', True, False)},
  {_seg_cols('prepaid', True, False)}
FROM s"""

P2 = f"""WITH {history(*FULL)},
s AS (SELECT CASE UPPER(TRIM(order_type)) WHEN 'B2B' THEN 'b2b' WHEN 'B2C' THEN 'b2c' END AS seg, * FROM e)
SELECT {_seg_cols('b2b', False, True)},
  {_seg_cols('b2c', False, True)}
FROM s WHERE seg IS NOT NULL"""


def _windows(req: HistoryRequest):
    cs, ce, ps, pe, _ = previous_window(req)
    return (cs, ce), (ps, pe)


def _two_window_cte(cur, prev) -> str:
    (cs, ce), (ps, pe) = cur, prev
    lo, hi = f"{min(cs, ps)} 00:00:00", f"{max(ce, pe)} 23:59:59"
    return f"""{history(lo, hi)},
w0 AS (SELECT *,
    CASE WHEN order_date BETWEEN TIMESTAMP '{cs} 00:00:00' AND TIMESTAMP '{ce} 23:59:59' THEN 1 ELSE 0 END AS is_cur,
    CASE WHEN order_date BETWEEN TIMESTAMP '{ps} 00:00:00' AND TIMESTAMP '{pe} 23:59:59' THEN 1 ELSE 0 END AS is_prev
  FROM e),
w AS (SELECT * FROM w0 WHERE is_cur = 1 OR is_prev = 1)"""


def _per(key: str, value: str) -> str:
    return f"""per AS (SELECT {key} AS k,
    COALESCE(SUM(CASE WHEN is_cur = 1 THEN {value} END), 0) AS cur,
    COALESCE(SUM(CASE WHEN is_prev = 1 THEN {value} END), 0) AS prev,
    SUM(is_cur) AS cur_rows, SUM(is_prev) AS prev_rows
  FROM w GROUP BY {key})"""


def p3() -> str:
    cur, prev = _windows(C.cmp_request())
    return f"""WITH {_two_window_cte(cur, prev)},
{_per('state', 'total_amount')},
top AS (SELECT k FROM per WHERE cur_rows > 0 ORDER BY cur DESC, k ASC LIMIT 5),
g AS (SELECT CASE WHEN k IN (SELECT k FROM top) THEN k ELSE 'REST' END AS bucket,
             SUM(cur) AS cur, SUM(prev) AS prev
      FROM per GROUP BY 1),
t AS (SELECT SUM(cur) AS tot FROM per)
SELECT bucket AS state, {money('cur')} AS current_revenue, {money('prev')} AS previous_revenue,
  ROUND({pct('cur', 'tot')}, 2) AS revenue_share, ROUND({growth('cur', 'prev')}, 2) AS growth_pct
FROM g, t"""


def p4() -> str:
    cur, prev = _windows(C.cmp_request())
    return f"""WITH {_two_window_cte(cur, prev)},
{_per(SKU, 'total_amount')},
cr AS (SELECT k, cur, prev, prev_rows, ROW_NUMBER() OVER (ORDER BY cur DESC, k ASC) AS current_rank
       FROM per WHERE cur_rows > 0),
pr AS (SELECT k, ROW_NUMBER() OVER (ORDER BY prev DESC, k ASC) AS previous_rank FROM per WHERE prev_rows > 0)
SELECT cr.k AS canonical_sku, current_rank, previous_rank, previous_rank - current_rank AS rank_change,
  {money('cur')} AS current_revenue, {money('prev')} AS previous_revenue,
  ROUND({growth('cur', 'prev')}, 2) AS growth_pct
FROM cr LEFT JOIN pr ON cr.k = pr.k WHERE current_rank <= 10"""


def p5() -> str:
    cur, prev = _windows(C.cmp_request())
    return f"""WITH {_two_window_cte(cur, prev)},
{_per('size_bucket', 'item_quantity')},
t AS (SELECT SUM(cur) AS tc, SUM(prev) AS tp FROM per),
x AS (SELECT k, CAST(cur AS DOUBLE) AS cur, CAST(prev AS DOUBLE) AS prev,
        {pct('cur', 'tc')} AS cs, {pct('prev', 'tp')} AS ps FROM per, t)
SELECT k AS size, cur AS current_units, prev AS previous_units, ROUND(cs, 2) AS current_share,
  ROUND(ps, 2) AS previous_share, ROUND(cs - ps, 2) AS share_change_pp, ROUND({growth('cur', 'prev')}, 2) AS growth_pct
FROM x"""


def _norm_sku(v: str) -> str:
    v = v.strip()
    return v[4:] if v.startswith("YCE_") else v


def p6(window: str) -> str:
    a, b = _norm_sku(C.P6_SKU_1), _norm_sku(C.P6_SKU_2)
    if window == "all-time":
        src = f"""{history(*FULL)},
w AS (SELECT 'current' AS win, * FROM e)"""
    else:
        end = datetime.fromisoformat(f"{C.CARD_END} 23:59:59")
        cs, ce, ps, pe = trailing_windows(end, 30 if window == "30d" else 7)
        src = f"""{history(f'{ps} 00:00:00', f'{ce} 23:59:59')},
w AS (SELECT 'current' AS win, * FROM e WHERE order_date BETWEEN TIMESTAMP '{cs} 00:00:00' AND TIMESTAMP '{ce} 23:59:59'
      UNION ALL
      SELECT 'previous' AS win, * FROM e WHERE order_date BETWEEN TIMESTAMP '{ps} 00:00:00' AND TIMESTAMP '{pe} 23:59:59')"""

    def block(p: str, win: str) -> str:
        o = f"COUNT(DISTINCT CASE WHEN win = '{win}' THEN order_id END)"
        amt = f"COALESCE(SUM(CASE WHEN win = '{win}' THEN total_amount END), 0)"
        c = f"COUNT(DISTINCT CASE WHEN win = '{win}' AND order_status = 'Cancelled' THEN order_id END)"
        r = f"COUNT(DISTINCT CASE WHEN win = '{win}' AND order_status = 'RTO' THEN order_id END)"
        return f"""{o} AS {p}_order_count,
    CAST(COALESCE(SUM(CASE WHEN win = '{win}' THEN item_quantity END), 0) AS DOUBLE) AS {p}_units,
    CAST({amt} AS DOUBLE) AS {p}_revenue, {ratio(amt, o)} AS {p}_aov,
    ROUND({pct(c, o)}, 2) AS {p}_cancellation_rate, ROUND({pct(r, o)}, 2) AS {p}_rto_rate"""

    metrics = ["order_count", "units", "revenue", "aov", "cancellation_rate", "rto_rate"]
    diffs = []
    for m in metrics:
        other = f"(SUM(cur_{m}) OVER () - cur_{m})"
        diffs.append(f"ROUND(cur_{m} - {other}, 2) AS {m}_diff_vs_other")
        if m in ("revenue", "units"):
            diffs.append(f"ROUND({growth(f'cur_{m}', other)}, 2) AS {m}_lift_pct_vs_other")
    growths = []
    if window != "all-time":
        for m in ("order_count", "units", "revenue", "aov"):
            growths.append(f"ROUND({growth(f'cur_{m}', f'prev_{m}')}, 2) AS {m}_growth_pct")
        for m in ("cancellation_rate", "rto_rate"):
            growths.append(f"ROUND(cur_{m} - prev_{m}, 2) AS {m}_change_pp")
    return f"""WITH {src},
names AS (SELECT 0 AS pos, '{a}' AS sku UNION ALL SELECT 1 AS pos, '{b}' AS sku),
m AS (SELECT n.pos, n.sku, {block('cur', 'current')},
    {block('prev', 'previous')}
  FROM names n LEFT JOIN w ON w.{SKU} = n.sku GROUP BY n.pos, n.sku)
SELECT CASE WHEN pos = 0 THEN 'sku_1' ELSE 'sku_2' END AS role, sku,
  cur_order_count AS order_count, cur_units AS units, cur_aov AS aov,
  cur_cancellation_rate AS cancellation_rate, cur_rto_rate AS rto_rate, ROUND(cur_revenue, 2) AS revenue,
  {', '.join(diffs + growths)}
FROM m"""


# ---- charts ---------------------------------------------------------------

def dyn_bucket(src: str = "e", granularity: str | None = None) -> str:
    """CTEs ``span`` and ``bk`` (rows with bucket ``b`` and grain ``grain``), grain from the data span."""
    if granularity:
        grain_expr = f"'{granularity}'"
    else:
        grain_expr = """CASE WHEN d <= 31 THEN 'daily' WHEN d <= 180 THEN 'weekly' ELSE 'monthly' END"""
    return f"""span AS (SELECT {grain_expr} AS grain FROM (
    SELECT CAST(floor((epoch(MAX(order_date)) - epoch(MIN(order_date))) / 86400) AS BIGINT) AS d FROM {src})),
bk AS (SELECT {src}.*, span.grain,
    CASE span.grain WHEN 'daily' THEN CAST(order_date AS DATE)
                    WHEN 'weekly' THEN CAST(date_trunc('week', order_date) AS DATE)
                    ELSE CAST(date_trunc('month', order_date) AS DATE) END AS b
  FROM {src}, span WHERE order_date IS NOT NULL)"""


DYN_LABEL = """strftime(b, '%Y-%m-%d') AS bucket,
  CASE grain WHEN 'daily' THEN strftime(b, '%Y-%m-%d')
             WHEN 'weekly' THEN strftime(b, '%b %d') || ' - ' || strftime(b + INTERVAL 6 DAY, '%b %d')
             ELSE strftime(b, '%b %Y') END AS label, grain"""


def _series(aggs: str, granularity: str | None = None) -> str:
    return f"""WITH {history(*FULL)}, {dyn_bucket('e', granularity)}
SELECT {DYN_LABEL}, {aggs} FROM bk GROUP BY b, grain"""


def _top_bases() -> str:
    return """tb AS (SELECT base_sku, ROW_NUMBER() OVER (ORDER BY u DESC, base_sku ASC) - 1 AS y_index
  FROM (SELECT base_sku, SUM(item_quantity) AS u FROM e GROUP BY base_sku ORDER BY u DESC, base_sku ASC LIMIT 10))"""


def charts() -> dict[str, str]:
    cur, prev = _windows(C.cmp_request())
    return {
        "g1_orders_line": _series("COUNT(DISTINCT order_id) AS orders"),
        "g1_orders_line_weekly": _series("COUNT(DISTINCT order_id) AS orders", "weekly"),
        "g2_units_line": _series("CAST(SUM(item_quantity) AS BIGINT) AS units"),
        "g3_revenue_line": _series(f"{money('SUM(total_amount)')} AS revenue"),
        "g4_orders_aov_line": _series(f"COUNT(DISTINCT order_id) AS orders, "
                                      f"{ratio('SUM(total_amount)', 'COUNT(DISTINCT order_id)')} AS aov"),
        "g5_payment_mix_area": _series("COUNT(CASE WHEN UPPER(TRIM(payment_mode)) = 'COD' THEN 1 END) AS cod, "
                                       "COUNT(CASE WHEN NOT (UPPER(TRIM(payment_mode)) = 'COD') THEN 1 END) AS prepaid"),
        "g6_order_type_mix_area": _series("COUNT(CASE WHEN UPPER(TRIM(order_type)) = 'B2B' THEN 1 END) AS b2b, "
                                          "COUNT(CASE WHEN UPPER(TRIM(order_type)) = 'B2C' THEN 1 END) AS b2c"),
        "g7_cancellation_return_rate_line": _series(
            f"{rate_orders('Cancelled')} AS cancellation_rate, {rate_orders('RTO')} AS rto_rate"),
        "g8_order_intensity_heatmap": f"""WITH {history(*FULL)},
cells AS (SELECT day_of_week, hour_of_day, COUNT(DISTINCT order_id) AS n FROM e GROUP BY 1, 2),
grid AS (SELECT CAST(floor(range / 24) AS INTEGER) AS day_index, CAST(range % 24 AS INTEGER) AS hour FROM range(168))
SELECT (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[day_index + 1] AS day_of_week, day_index, hour,
  COALESCE(n, 0) AS order_count
FROM grid LEFT JOIN cells ON grid.day_index = cells.day_of_week AND grid.hour = cells.hour_of_day""",
        "g9_top_skus_units": f"""WITH {history(*FULL)}
SELECT {SKU} AS canonical_sku, CAST(SUM(item_quantity) AS DOUBLE) AS units FROM e
GROUP BY {SKU} ORDER BY SUM(item_quantity) DESC, {SKU} ASC LIMIT 10""",
        "g10_top_skus_revenue": f"""WITH {history(*FULL)}
SELECT {SKU} AS canonical_sku, {money('SUM(total_amount)')} AS revenue FROM e
GROUP BY {SKU} ORDER BY SUM(total_amount) DESC, {SKU} ASC LIMIT 10""",
        "g11_sku_revenue_vs_cancellation": f"""WITH {history(*FULL)}
SELECT {SKU} AS canonical_sku, {money('SUM(total_amount)')} AS x_revenue,
  {rate_orders('Cancelled')} AS y_cancellation_rate, CAST(SUM(item_quantity) AS DOUBLE) AS r_units
FROM e GROUP BY {SKU} ORDER BY SUM(total_amount) DESC, {SKU} ASC LIMIT 50""",
        "g12_base_sku_size_heatmap": f"""WITH {history(*FULL)}, {_top_bases()},
cells AS (SELECT e.base_sku, size_bucket, SUM(item_quantity) AS units FROM e JOIN tb ON e.base_sku = tb.base_sku
          GROUP BY e.base_sku, size_bucket)
SELECT cells.base_sku, size_bucket AS size, CAST(DENSE_RANK() OVER (ORDER BY size_bucket) - 1 AS INTEGER) AS x_index,
  CAST(y_index AS INTEGER) AS y_index, CAST(units AS DOUBLE) AS units
FROM cells JOIN tb ON cells.base_sku = tb.base_sku""",
        "g13_top_base_sku_size_distribution": f"""WITH {history(*FULL)}, {_top_bases()},
cells AS (SELECT e.base_sku, size_bucket, SUM(item_quantity) AS units FROM e JOIN tb ON e.base_sku = tb.base_sku
          GROUP BY e.base_sku, size_bucket),
sz AS (SELECT size_bucket, ROW_NUMBER() OVER (ORDER BY size_bucket) - 1 AS x_index FROM (SELECT DISTINCT size_bucket FROM cells)),
grid AS (SELECT tb.base_sku, y_index, sz.size_bucket, x_index, COALESCE(units, 0) AS units FROM tb CROSS JOIN sz
         LEFT JOIN cells ON cells.base_sku = tb.base_sku AND cells.size_bucket = sz.size_bucket)
SELECT base_sku, CAST(y_index AS INTEGER) AS y_index, size_bucket AS size, CAST(x_index AS INTEGER) AS x_index,
  CAST(units AS DOUBLE) AS units, ROUND({pct('units', 'SUM(units) OVER (PARTITION BY base_sku)')}, 2) AS share_pct
FROM grid""",
        "g14_top_sku_weekly_velocity": f"""WITH {history(*FULL)},
t AS (SELECT {SKU} AS k FROM e GROUP BY {SKU} ORDER BY SUM(item_quantity) DESC, {SKU} ASC LIMIT 1),
x AS (SELECT {SKU} AS top_sku, CAST(date_trunc('week', order_date) AS DATE) AS b, item_quantity FROM e
      WHERE {SKU} IN (SELECT k FROM t) AND order_date IS NOT NULL)
SELECT top_sku, CAST(SUM(item_quantity) AS DOUBLE) AS units, strftime(b, '%Y-%m-%d') AS bucket,
  strftime(b, '%b %d') || ' - ' || strftime(b + INTERVAL 6 DAY, '%b %d') AS label
FROM x GROUP BY top_sku, b""",
        "g15_sku_revenue_change_waterfall": f"""WITH {_two_window_cte(cur, prev)},
{_per(SKU, 'total_amount')},
d AS (SELECT k, cur, prev, cur - prev AS delta FROM per),
t AS (SELECT SUM(delta) AS tot FROM d)
SELECT k AS canonical_sku, {money('cur')} AS current_revenue, {money('prev')} AS previous_revenue,
  {money('delta')} AS delta_revenue, ROUND({pct('delta', 'tot')}, 2) AS contribution_pct, {money('tot')} AS total_change
FROM d, t ORDER BY abs(delta) DESC, k ASC LIMIT 20""",
    }


def queries() -> dict[str, str]:
    out = {"p1_cod_vs_prepaid": P1, "p2_b2b_vs_b2c": P2, "p3_top_states_vs_rest": p3(),
           "p4_top_skus_rank_growth": p4(), "p5_size_mix_change": p5(),
           "p6_sku_vs_sku_30d": p6("30d"), "p6_sku_vs_sku_all_time": p6("all-time")}
    out.update(charts())
    return out
