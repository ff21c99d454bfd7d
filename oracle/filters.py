"""Oracle SQL for the filter queries."""

from __future__ import annotations

from orderlens.plans import catalog as C

from .base import history
from .kpis import K0
from .posted import BASE


def queries() -> dict[str, str]:
    q = {}
    full = history(f"{C.FULL_START} 00:00:00", f"{C.FULL_END} 23:59:59")
    dims = ("LOWER(TRIM(marketplace)) IN ('building', 'machinery') AND LOWER(TRIM(courier)) = 'nation_7'")
    q["f2_dimension_filter_kpis"] = K0.replace(full, history(f"{C.FULL_START} 00:00:00", f"{C.FULL_END} 23:59:59",
                                                              where=dims))
    days = ", ".join(f"'{d}'" for d in C.F3_DAYS)
    q["f3_day_filter_orders"] = f"""WITH {history(f"{C.FULL_START} 00:00:00", f"{C.FULL_END} 23:59:59",
                                                 where=f"strftime(order_date, '%Y-%m-%d') IN ({days})")}
SELECT strftime(order_date, '%Y-%m-%d') AS day, COUNT(DISTINCT order_id) AS orders FROM e GROUP BY 1"""
    q["f4_predicate_filter"] = f"""{BASE}
SELECT state, payment_mode, COUNT(*) AS rows FROM ol
WHERE LOWER(COALESCE(payment_mode, '')) LIKE '%paid%' AND COALESCE(item_quantity, 0) >= 10
  AND (order_status IS DISTINCT FROM 'RTO') AND state IN ('NATION_1', 'NATION_2', 'NATION_3')
GROUP BY 1, 2"""
    q["f4_posted_text_money"] = f"""{BASE},
n AS (SELECT order_id, SUM(item_quantity) AS order_quantity FROM ol GROUP BY order_id)
SELECT state, COUNT(*) AS orders FROM od JOIN n ON od.order_id = n.order_id
WHERE total_amount >= 50000 AND total_amount < 250000.5 AND order_quantity <> 33 GROUP BY state"""
    q["f5_nested_predicate_filter"] = f"""{BASE},
m AS (SELECT order_id FROM li GROUP BY order_id
      HAVING bool_or(regexp_extract(sku, '_([^_]*)$', 1) = '7')
         AND bool_or(CAST(mrp AS DOUBLE) > 1500)
         AND bool_or(LOWER(sku) LIKE '%yce\\_%' ESCAPE '\\'))
SELECT COUNT(*) AS orders FROM m"""
    q["f8_state_pincodes"] = f"""{BASE}
SELECT pin_code, COUNT(*) AS orders FROM od WHERE state IS NOT NULL AND pin_code IS NOT NULL
  AND LOWER(state) = 'nation_11' GROUP BY pin_code"""
    return q
