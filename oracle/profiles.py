"""Oracle SQL for the per-SKU profile tables."""

from __future__ import annotations

from orderlens.plans import catalog as C

from .base import ORDER_LINES, dround

P = f"""WITH ol AS ({ORDER_LINES}),
r AS (SELECT *, regexp_replace(TRIM(raw_sku), '^([^0-9-]*-)*', '') AS rest FROM ol),
p AS (SELECT
    CASE WHEN strpos(rest, '-') > 0 THEN regexp_replace(rest, '-[^-]*$', '') ELSE raw_sku END AS canonical_sku,
    CASE WHEN strpos(rest, '-') > 0 THEN regexp_extract(rest, '[^-]*$', 0) ELSE '' END AS parsed_size,
    order_id, order_date, CAST(order_date AS DATE) AS day, order_status, payment_mode, marketplace, state, courier,
    import_warehouse_name, CAST(item_quantity AS DECIMAL(18,4)) AS qty, CAST(mrp AS DECIMAL(18,4)) AS sp,
    CAST(cost AS DECIMAL(18,4)) AS cp, CAST(mrp AS DECIMAL(18,4)) AS unit_mrp,
    CAST(mrp AS DECIMAL(18,4)) * CAST(item_quantity AS DECIMAL(18,4)) AS revenue,
    CAST(cost AS DECIMAL(18,4)) * CAST(item_quantity AS DECIMAL(18,4)) AS cogs,
    CAST(mrp AS DECIMAL(18,4)) * CAST(item_quantity AS DECIMAL(18,4)) AS total_mrp
  FROM r)"""


def r2(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


def pct(n: str, d: str) -> str:
    return dround(f"COALESCE(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * 100.0, 0.0)")


def unit_prices() -> str:
    sp = "COALESCE(CAST(rev AS DOUBLE) / NULLIF(CAST(units AS DOUBLE), 0), 0.0)"
    cp = "COALESCE(CAST(cogs AS DOUBLE) / NULLIF(CAST(units AS DOUBLE), 0), 0.0)"
    mr = "COALESCE(CAST(tmrp AS DOUBLE) / NULLIF(CAST(units AS DOUBLE), 0), 0.0)"
    return (f"{dround(sp)} AS avg_sp, {dround(cp)} AS avg_cp, {dround(mr)} AS avg_mrp, "
            f"{pct('rev - cogs', 'rev')} AS gross_margin_pct, "
            f"{dround(f'COALESCE(({mr} - {sp}) / NULLIF({mr}, 0) * 100.0, 0.0)')} AS mrp_discount_pct")


DAILY_AGG = """SELECT canonical_sku, day, SUM(revenue) AS rev, SUM(qty) AS units, COUNT(DISTINCT order_id) AS orders,
    SUM(cogs) AS cogs, SUM(total_mrp) AS tmrp FROM p GROUP BY canonical_sku, day"""


def daily_select(day_expr: str = "strftime(day, '%Y-%m-%d')") -> str:
    return (f"SELECT canonical_sku, {day_expr} AS day, {r2('rev')} AS revenue, {r2('units')} AS units_sold, orders, "
            f"{r2('rev - cogs')} AS gross_profit, {r2('cogs')} AS cogs, {r2('tmrp')} AS total_mrp, {unit_prices()} FROM g")


def rolling() -> str:
    cols = []
    for n in (7, 30):
        for kind, frame in (("rows", f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"),
                            ("days", f"RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW")):
            order = "day" if kind == "rows" else "dn"
            w = f"OVER (PARTITION BY canonical_sku ORDER BY {order} {frame})"
            cols += [f"ROUND(SUM(revenue) {w}, 2) AS r{n}{kind}_revenue",
                     f"ROUND(SUM(units_sold) {w}, 2) AS r{n}{kind}_units_sold",
                     f"CAST(SUM(orders) {w} AS BIGINT) AS r{n}{kind}_orders",
                     f"ROUND(COALESCE(SUM(gross_profit) {w} / NULLIF(SUM(revenue) {w}, 0) * 100.0, 0.0), 2) AS r{n}{kind}_gross_margin_pct"]
    return f"""{P}, g AS ({DAILY_AGG}), d AS ({daily_select('day')}),
x AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS dn FROM d),
y AS (SELECT canonical_sku, day, {', '.join(cols)},
        ROW_NUMBER() OVER (PARTITION BY canonical_sku ORDER BY day DESC) AS rn FROM x)
SELECT canonical_sku, strftime(day, '%Y-%m-%d') AS last_day, * EXCLUDE (canonical_sku, day, rn) FROM y WHERE rn = 1"""


def queries() -> dict[str, str]:
    q = {}
    q["u1_sku_profile_cumulative"] = f"""{P}, g AS (SELECT canonical_sku, SUM(revenue) AS rev, SUM(qty) AS units,
    COUNT(DISTINCT order_id) AS total_orders, SUM(cogs) AS cogs FROM p GROUP BY canonical_sku)
SELECT canonical_sku, {r2('rev')} AS total_revenue, {r2('units')} AS total_units_sold, total_orders,
  {dround('COALESCE(CAST(rev AS DOUBLE) / NULLIF(CAST(total_orders AS DOUBLE), 0), 0.0)')} AS avg_order_value,
  {r2('cogs')} AS total_cogs, {pct('rev - cogs', 'rev')} AS gross_margin_pct FROM g"""
    q["u2_status_breakdown"] = f"""{P}, g AS (SELECT canonical_sku, LOWER(order_status) AS status, COUNT(DISTINCT order_id) AS orders
  FROM p GROUP BY 1, 2),
t AS (SELECT *, GREATEST(SUM(orders) OVER (PARTITION BY canonical_sku), 1) AS tot,
  SUM(CASE WHEN status = 'cancelled' THEN orders ELSE 0 END) OVER (PARTITION BY canonical_sku) AS c,
  SUM(CASE WHEN status = 'returned' THEN orders ELSE 0 END) OVER (PARTITION BY canonical_sku) AS r FROM g)
SELECT canonical_sku, status, orders, {pct('c', 'tot')} AS cancellation_rate, {pct('r', 'tot')} AS return_rate FROM t"""
    q["u3_payment_split"] = f"""{P} SELECT canonical_sku, payment_mode, COUNT(DISTINCT order_id) AS orders,
  {r2('SUM(revenue)')} AS revenue FROM p GROUP BY 1, 2"""
    q["u4_by_marketplace"] = f"""{P}, g AS (SELECT canonical_sku, marketplace, SUM(revenue) AS rev, SUM(qty) AS units,
    COUNT(DISTINCT order_id) AS order_count, AVG(CAST(sp AS DOUBLE)) AS avg_sp, AVG(CAST(unit_mrp AS DOUBLE)) AS avg_mrp,
    AVG(CAST(cp AS DOUBLE)) AS avg_cost, SUM(cogs) AS cogs FROM p GROUP BY 1, 2)
SELECT canonical_sku, marketplace, {r2('rev')} AS revenue, {r2('units')} AS units_sold, order_count,
  {dround('avg_sp')} AS avg_selling_price, {dround('avg_mrp')} AS avg_mrp, {dround('avg_cost')} AS avg_cost,
  {pct('rev - cogs', 'rev')} AS gross_margin_pct,
  {dround('COALESCE((avg_mrp - avg_sp) / NULLIF(avg_mrp, 0) * 100.0, 0.0)')} AS mrp_discount_pct,
  {pct('rev', 'SUM(rev) OVER (PARTITION BY canonical_sku)')} AS revenue_share_pct FROM g"""
    q["u5_price_history"] = f"""{P}, g AS (SELECT canonical_sku, day, marketplace, SUM(revenue) AS rev, SUM(cogs) AS cogs,
    SUM(total_mrp) AS tmrp, SUM(qty) AS units FROM p GROUP BY 1, 2, 3)
SELECT canonical_sku, strftime(day, '%Y-%m-%d') AS date, marketplace, {unit_prices()} FROM g"""
    q["u6_by_state"] = f"""{P}, g AS (SELECT canonical_sku, state, {r2('SUM(revenue)')} AS revenue, {r2('SUM(qty)')} AS units_sold
  FROM p GROUP BY 1, 2),
x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY canonical_sku ORDER BY revenue DESC, state ASC) AS revenue_rank FROM g)
SELECT canonical_sku, state, revenue, units_sold, CAST(revenue_rank AS INTEGER) AS revenue_rank,
  revenue_rank <= 5 AS is_top_state FROM x"""
    q["u7_by_size"] = f"""{P}, g AS (SELECT canonical_sku, parsed_size AS size, SUM(qty) AS units, SUM(revenue) AS rev
  FROM p GROUP BY 1, 2)
SELECT canonical_sku, size, {r2('units')} AS units_sold, {r2('rev')} AS revenue,
  {pct('rev', 'SUM(rev) OVER (PARTITION BY canonical_sku)')} AS revenue_share_pct FROM g"""
    q["u8_fulfilment_distribution"] = f"""{P}
SELECT canonical_sku, 'courier_orders' AS distribution, courier AS key, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS value
FROM p GROUP BY 1, 3
UNION ALL
SELECT canonical_sku, 'warehouse_units' AS distribution, import_warehouse_name AS key, {r2('SUM(qty)')} AS value
FROM p GROUP BY 1, 3"""
    daily = f"{P}, g AS ({DAILY_AGG}) {daily_select()}"
    q["u9_daily_series"] = daily
    q["u10_rolling"] = rolling()
    q["u11_merge_incremental"] = daily
    q["u12_incremental_job"] = daily
    late, split = f"TIMESTAMP '{C.U_LATE_FROM} 00:00:00'", f"TIMESTAMP '{C.U_SPLIT} 00:00:00'"
    two_runs = f"""{P}, late AS (SELECT DISTINCT canonical_sku FROM p WHERE order_date >= {late}),
q AS (SELECT *, sp * (qty + 1) AS rev, qty + 1 AS units, TRUE AS again FROM p WHERE order_date >= {late}
      UNION ALL SELECT *, sp * qty AS rev, qty AS units, FALSE AS again FROM p WHERE order_date < {split}),
last AS (SELECT * FROM q WHERE again OR canonical_sku NOT IN (SELECT canonical_sku FROM late))"""
    q["u12_breakdowns_after_two_runs"] = f"""{two_runs}
SELECT canonical_sku, 'payment' AS breakdown, payment_mode AS key, {r2('SUM(rev)')} AS revenue FROM last GROUP BY 1, 3
UNION ALL
SELECT canonical_sku, 'size' AS breakdown, parsed_size AS key, {r2('SUM(rev)')} AS revenue FROM last GROUP BY 1, 3"""
    q["u12_daily_new_values_win"] = f"""{two_runs}
SELECT canonical_sku, strftime(day, '%Y-%m-%d') AS day, {r2('SUM(units)')} AS units_sold,
  COUNT(DISTINCT order_id) AS orders, {r2('SUM(rev)')} AS revenue FROM q GROUP BY canonical_sku, day"""
    q["u13_profile_export"] = f"""WITH c AS ({q["u1_sku_profile_cumulative"]}), d AS ({daily})
SELECT c.*, d.day AS order_date, d.revenue, d.units_sold, d.orders FROM c JOIN d USING (canonical_sku)"""
    prices = dround("COALESCE(CAST(SUM(rev) AS DOUBLE) / NULLIF(CAST(SUM(units) AS DOUBLE), 0), 0.0)")

    def section(name: str, key: str, value: str, rows: str = "last") -> str:
        return f"SELECT canonical_sku, '{name}' AS section, {key} AS key, CAST({value} AS DOUBLE) AS value FROM {rows} GROUP BY 1, 3"

    revenue, units, orders = r2("SUM(rev)"), r2("SUM(units)"), "COUNT(DISTINCT order_id)"
    date = "strftime(day, '%Y-%m-%d')"
    sections = [section("status", "LOWER(order_status)", orders), section("payment", "payment_mode", revenue),
                section("marketplace", "marketplace", units), section("state", "state", revenue),
                section("size", "parsed_size", units), section("fulfilment", "concat_ws('|', 'courier_orders', courier)", orders),
                section("fulfilment", "concat_ws('|', 'warehouse_units', import_warehouse_name)", units),
                section("daily", date, revenue, "q"),
                section("price_history", f"concat_ws('|', {date}, marketplace)", prices, "q")]
    q["s13_profile_documents"] = f"""{two_runs},
days AS (SELECT canonical_sku, {date} AS day, {units} AS units, ROW_NUMBER() OVER (PARTITION BY canonical_sku ORDER BY day DESC) AS back
         FROM q GROUP BY canonical_sku, q.day)
{" UNION ALL ".join(sections)}
UNION ALL SELECT canonical_sku, 'cumulative', 'total_units_sold', ROUND(SUM(units), 2) FROM days GROUP BY 1
UNION ALL SELECT canonical_sku, 'rolling', MAX(day), ROUND(SUM(units) FILTER (WHERE back <= 7), 2) FROM days GROUP BY 1"""
    return q
