"""Oracle SQL for C4 and the source/sink queries."""

from __future__ import annotations

from orderlens.plans import catalog as C

from .base import ORDER_LINES, PAYMENT_CYCLE, VENDOR_COST_SHEET, history
from .kpis import K0
from .posted import BASE

FIRST = f"""{BASE},
fs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY line_no, sku, raw_sku, model_no, product_name, brand,
         CAST(CAST(mrp AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(cost AS DECIMAL(18,4)) AS VARCHAR)) AS rn2 FROM ol),
c4 AS (SELECT CAST(od.order_id AS VARCHAR) AS invoice_id, CAST(od.order_id AS VARCHAR) AS order_id, fs.sku,
         fs.raw_sku AS suborder_marketplace_sku, NULLIF(regexp_extract(fs.sku, '_([^_]*)$', 1), '') AS size,
         fs.item_quantity, CAST(CAST(fs.mrp AS DECIMAL(18,4)) AS VARCHAR) AS suborder_mrp, fs.sku AS canonical_sku, od.payment_mode, od.state
       FROM od JOIN fs ON od.order_id = fs.order_id AND fs.rn2 = 1)"""


def queries() -> dict[str, str]:
    q = {}
    q["c4_ingest_projection"] = f"{FIRST} SELECT * FROM c4"
    q["s11_upsert_history"] = f"{FIRST} SELECT * FROM c4"
    q["s1_s10_daily_json_roundtrip"] = f"""{BASE}
SELECT strftime(order_date, '%Y-%m-%d') AS day, COUNT(*) AS orders FROM od GROUP BY 1"""
    q["s12_extraction_run"] = f"""{BASE}
SELECT strftime(order_date, '%Y-%m-%d') AS day, COUNT(*) AS orders_landed, COUNT(DISTINCT order_id) AS rows_upserted
FROM od GROUP BY 1"""
    q["s5_vendor_cost_sheet"] = f"""WITH v AS ({VENDOR_COST_SHEET}) SELECT style_name, collection_name, brand,
  CAST(mrp AS DOUBLE) AS mrp, CAST(final_price AS DOUBLE) AS final_price FROM v"""
    q["s6_payment_cycle_for_party"] = f"WITH pc AS ({PAYMENT_CYCLE}) SELECT * FROM pc WHERE party_name = '{C.S6_PARTY}'"
    parts = []
    for name, col in (("warehouse_names", "import_warehouse_name"), ("marketplace_names", "marketplace"),
                      ("courier_names", "courier"), ("billing_state_names", "state")):
        parts.append(f"SELECT DISTINCT '{name}' AS option, TRIM({col}) AS value FROM ol "
                     f"WHERE {col} IS NOT NULL AND TRIM({col}) <> ''")
    q["s7_filter_options"] = f"WITH ol AS ({ORDER_LINES})\n" + "\nUNION ALL\n".join(parts)
    q["s9_preview"] = f"""WITH {history(f'{C.FULL_START} 00:00:00', f'{C.FULL_END} 23:59:59')}
SELECT order_id, sku, order_status, payment_mode, state, CAST(total_amount AS DOUBLE) AS total_amount, item_quantity,
  (SELECT COUNT(*) FROM e) AS total_rows_fetched
FROM e ORDER BY order_date, order_id, sku LIMIT 3"""
    presets = []
    for p, (s, e) in (("7d", ("2001-07-25 00:00:00", "2001-07-31 23:59:59")),
                      ("30d", ("2001-07-02 00:00:00", "2001-07-31 23:59:59")),
                      ("all_time", (f"{C.FULL_START} 00:00:00", "2001-07-31 23:59:59"))):
        k0 = K0.replace(history(f"{C.FULL_START} 00:00:00", f"{C.FULL_END} 23:59:59"), history(s, e))
        for m in ("total_orders", "units_sold", "gross_revenue", "aov", "unique_skus", "cancellation_rate",
                  "return_rate", "cod_share", "delivered_rate"):
            presets.append(f"SELECT '{p}' AS preset, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({k0}) t")
    q["s16_kpi_presets"] = "\nUNION ALL\n".join(f"({x})" for x in presets)
    return q
