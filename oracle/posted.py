"""Oracle SQL for C1 and N1–N13, computed from order_lines directly (order grain = GROUP BY order_id)."""

from __future__ import annotations

from orderlens.plans import catalog as C

from .base import ORDER_LINES, money, pct, ratio

BASE = f"""WITH ol AS ({ORDER_LINES}),
fl AS (SELECT order_id, order_status, courier, import_warehouse_name,
         ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY line_no, order_status, courier, import_warehouse_name) AS rn
       FROM ol),
o AS (SELECT ol.order_id, MIN(order_date) AS order_date, SUM(total_amount) AS total_amount,
        MIN(payment_mode) AS payment_mode, MIN(state) AS state, MIN(pin_code) AS pin_code,
        MIN(order_type) AS order_type, MIN(marketplace) AS marketplace
      FROM ol GROUP BY ol.order_id),
od AS (SELECT o.*, fl.order_status FROM o JOIN fl ON o.order_id = fl.order_id AND fl.rn = 1),
li AS (SELECT order_id, order_date, state, sku, product_name AS productName, mrp AS selling_price, cost, mrp,
         item_quantity, line_no, order_status,
         CASE WHEN order_status = 'Cancelled' THEN item_quantity ELSE 0 END AS cancelled_quantity,
         CASE WHEN order_status IN ('Shipped', 'Manifest Scanned') THEN item_quantity ELSE 0 END AS shipped_quantity,
         CASE WHEN order_status IN ('Returned', 'RTO') THEN item_quantity ELSE 0 END AS returned_quantity
       FROM ol)"""

SPAN = "(SELECT CAST(floor((epoch(MAX(order_date)) - epoch(MIN(order_date))) / 86400) AS BIGINT) FROM od)"
GRAIN = f"(CASE WHEN {SPAN} <= 7 THEN 'daily' WHEN {SPAN} <= 90 THEN 'weekly' ELSE 'monthly' END)"


def _b(col: str = "order_date") -> str:
    return (f"CASE {GRAIN} WHEN 'daily' THEN CAST({col} AS DATE) WHEN 'weekly' THEN CAST(date_trunc('week', {col}) AS DATE) "
            f"ELSE CAST(date_trunc('month', {col}) AS DATE) END")


LABEL = f"""strftime(b, '%Y-%m-%d') AS bucket, is_total,
  CASE WHEN is_total THEN 'total' ELSE CASE {GRAIN} WHEN 'daily' THEN strftime(b, '%a')
    WHEN 'weekly' THEN strftime(b, '%b %d') || ' - ' || strftime(b + INTERVAL 6 DAY, '%b %d')
    ELSE strftime(b, '%b %Y') END END AS label, {GRAIN} AS grain"""


def queries() -> dict[str, str]:
    q = {}
    q["c1_flatten_orders"] = f"""{BASE}
SELECT CAST(li.order_id AS VARCHAR) AS order_id, od.order_status, od.payment_mode, li.sku AS suborder_sku,
  li.item_quantity AS suborder_item_quantity, li.cancelled_quantity AS suborder_cancelled_quantity,
  li.returned_quantity AS suborder_returned_quantity, regexp_extract(li.sku, '_([^_]*)$', 1) AS suborder_size
FROM li JOIN od ON li.order_id = od.order_id"""
    q["n1_volume"] = f"""{BASE}
SELECT (SELECT COUNT(*) FROM od) AS total_orders, CAST(COALESCE(SUM(shipped_quantity), 0) AS BIGINT) AS total_skus_sold,
  CAST(COALESCE(SUM(item_quantity), 0) - COALESCE(SUM(cancelled_quantity), 0) AS BIGINT) AS net_skus_sold,
  COUNT(DISTINCT sku) AS unique_skus_ordered FROM li"""
    q["n1_n7_by_state"] = f"""{BASE}
SELECT state, COUNT(*) AS order_count, {money('SUM(total_amount)')} AS revenue,
  ROUND({pct("COUNT(CASE WHEN LOWER(TRIM(order_status)) = 'cancelled' THEN 1 END)", 'COUNT(*)')}, 2) AS cancellation_pct
FROM od WHERE state IS NOT NULL GROUP BY state"""
    q["n2_revenue"] = f"""{BASE},
x AS (SELECT (SELECT SUM(total_amount) FROM od) AS rev, (SELECT COUNT(*) FROM od) AS n,
        SUM(cost) AS cost, SUM(selling_price) AS sp, COUNT(*) AS lines FROM li)
SELECT {money('COALESCE(rev, 0)')} AS gross_revenue,
  {money('CASE WHEN COALESCE(cost, 0) > 0 THEN COALESCE(rev, 0) - COALESCE(cost, 0) ELSE 0 END')} AS gross_margin,
  {ratio('COALESCE(rev, 0)', 'n')} AS aov, {ratio('sp', 'lines')} AS asp FROM x"""
    q["n3_payment"] = f"""{BASE},
x AS (SELECT COUNT(CASE WHEN payment_mode = 'COD' THEN 1 END) AS cod_orders,
  COUNT(CASE WHEN payment_mode IS NOT NULL AND payment_mode <> 'COD' THEN 1 END) AS prepaid_orders, COUNT(*) AS n FROM od)
SELECT cod_orders, prepaid_orders, ROUND({pct('cod_orders', 'n')}, 2) AS cod_percentage,
  ROUND({pct('prepaid_orders', 'n')}, 2) AS prepaid_percentage FROM x"""
    q["n3_payment_breakdown"] = f"""{BASE}
SELECT payment_mode, COUNT(*) AS orders FROM od WHERE payment_mode IS NOT NULL GROUP BY payment_mode"""
    q["n4_cancellation"] = f"""{BASE},
x AS (SELECT COUNT(CASE WHEN LOWER(TRIM(order_status)) = 'cancelled' THEN 1 END) AS cancelled_orders,
  COUNT(CASE WHEN LOWER(TRIM(order_status)) = 'returned' THEN 1 END) AS rto_orders, COUNT(*) AS n FROM od),
t AS (SELECT state FROM od WHERE LOWER(TRIM(order_status)) = 'returned' AND state IS NOT NULL
      GROUP BY state ORDER BY COUNT(*) DESC, state ASC LIMIT 1)
SELECT ROUND({pct('rto_orders', 'n')}, 2) AS rto_rate, ROUND({pct('cancelled_orders', 'n')}, 2) AS cancellation_rate,
  cancelled_orders, rto_orders, (SELECT state FROM t) AS highest_state_rto FROM x"""
    q["n5_day_frequency"] = f"""{BASE},
d AS (SELECT CAST(order_date AS DATE) AS day, COUNT(*) AS orders FROM od WHERE order_date IS NOT NULL GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, orders,
  ROUND(AVG(orders) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_average_7d FROM d"""
    q["n6_processing_times"] = f"""{BASE},
x AS (SELECT AVG(CAST(line_no AS DOUBLE)) AS i, AVG(CAST(line_no AS DOUBLE)) AS q FROM li)
SELECT ROUND(COALESCE(i, 0), 4) AS avg_inventory_assignment_time_hours, ROUND(COALESCE(q, 0), 4) AS avg_qc_time_hours,
  ROUND(COALESCE(i, 0) + COALESCE(q, 0), 4) AS avg_order_processing_time_hours FROM x"""
    parts = []
    for name, key, val in (("top_skus_by_quantity", "sku", "item_quantity"),
                           ("top_skus_by_revenue", "sku", "selling_price * item_quantity"),
                           ("top_products_by_quantity", "productName", "item_quantity")):
        parts.append(f"""(SELECT '{name}' AS list, {key} AS key, CAST(ROUND(SUM({val}), 2) AS DOUBLE) AS value FROM li
  WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY SUM({val}) DESC, {key} ASC LIMIT 10)""")
    q["n8_top_products"] = f"{BASE}\n" + "\nUNION ALL\n".join(parts)
    total = "GROUPING(b) = 1 AS is_total"
    q["n9_volume_chart"] = f"""{BASE},
oo AS (SELECT {_b()} AS b FROM od WHERE order_date IS NOT NULL),
ll AS (SELECT {_b()} AS b, sku FROM li WHERE order_date IS NOT NULL AND sku IS NOT NULL AND sku <> ''),
ob AS (SELECT b, {total}, COUNT(*) AS order_count FROM oo GROUP BY ROLLUP (b)),
lb AS (SELECT b, COUNT(DISTINCT sku) AS unique_sku_count FROM ll GROUP BY ROLLUP (b))
SELECT {LABEL}, order_count, COALESCE(unique_sku_count, 0) AS unique_sku_count FROM ob LEFT JOIN lb ON ob.b IS NOT DISTINCT FROM lb.b""".replace(
        "strftime(b", "strftime(ob.b")
    q["n10_revenue_chart"] = f"""{BASE},
r AS (SELECT {_b()} AS b, total_amount FROM od WHERE order_date IS NOT NULL),
x AS (SELECT b, {total}, SUM(total_amount) AS rev, COUNT(*) AS orders FROM r GROUP BY ROLLUP (b))
SELECT {LABEL}, {money('rev')} AS revenue, orders, {ratio('rev', 'orders')} AS aov FROM x"""
    q["n11_payment_chart"] = f"""{BASE},
r AS (SELECT {_b()} AS b, payment_mode FROM od WHERE order_date IS NOT NULL),
x AS (SELECT b, {total}, COUNT(CASE WHEN payment_mode = 'COD' THEN 1 END) AS cod,
  COUNT(CASE WHEN payment_mode IS NOT NULL AND payment_mode <> 'COD' THEN 1 END) AS prepaid FROM r GROUP BY ROLLUP (b))
SELECT {LABEL}, cod, prepaid FROM x"""
    q["n12_cancellation_chart"] = f"""{BASE},
r AS (SELECT {_b()} AS b, cancelled_quantity, returned_quantity FROM li WHERE order_date IS NOT NULL),
x AS (SELECT b, {total}, CAST(SUM(cancelled_quantity) AS BIGINT) AS cancelled,
  CAST(SUM(returned_quantity) AS BIGINT) AS returned FROM r GROUP BY ROLLUP (b))
SELECT {LABEL}, cancelled, returned FROM x"""
    q["n13_pincodes_in_state"] = f"""{BASE},
p AS (SELECT CAST(pin_code AS VARCHAR) AS b FROM od
  WHERE state IS NOT NULL AND pin_code IS NOT NULL AND LOWER(state) = LOWER('{C.N13_STATE}'))
SELECT b AS pin_code, COUNT(*) AS order_count, {total} FROM p GROUP BY ROLLUP (b)"""
    return q
