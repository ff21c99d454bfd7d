"""Shared SQL fragments: the order_lines fixture view and the enriched history CTE.

The fixture text is the one in FIXTURES.md §2.1; the enrichment mirrors the
cleaning rules (C10–C16) written independently in SQL.
"""

from __future__ import annotations

ORDER_LINES = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no,
  o.o_orderdate + CAST(o.o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS order_date,
  CAST(l.l_extendedprice AS DECIMAL(12,2))
    * (CAST(1 AS DECIMAL(3,2)) - CAST(l.l_discount AS DECIMAL(3,2))) AS total_amount,
  CAST(l.l_quantity AS BIGINT) AS item_quantity,
  CASE WHEN l.l_returnflag='R' AND l.l_linestatus='O' THEN 'RTO'
       WHEN l.l_returnflag='R' THEN 'Returned'
       WHEN l.l_returnflag='A' AND l.l_linestatus='O' THEN 'Cancelled'
       WHEN l.l_returnflag='A' THEN 'Shipped'
       WHEN l.l_linestatus='O' THEN 'Open' ELSE 'Manifest Scanned' END AS order_status,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'COD' WHEN '2-HIGH' THEN ' cod '
       WHEN '3-MEDIUM' THEN 'PrePaid' WHEN '4-NOT SPECIFIED' THEN 'PREPAID' END AS payment_mode,
  CASE WHEN c.c_mktsegment IN ('BUILDING','AUTOMOBILE') THEN 'B2B'
       WHEN c.c_mktsegment='MACHINERY' THEN 'B2B2C' ELSE 'B2C' END AS order_type,
  n.n_name AS state, c.c_mktsegment AS marketplace, sn.n_name AS courier, sr.r_name AS import_warehouse_name,
  CAST(c.c_custkey % 1000 AS STRING) AS pin_code,
  CONCAT(CASE WHEN l.l_linenumber % 2 = 0 THEN 'YCE_' ELSE '' END,
         CAST(l.l_partkey % 200 AS STRING), '_', CAST(p.p_size % 12 AS STRING)) AS sku,
  CONCAT('ABC-', CAST(l.l_partkey % 200 AS STRING), '-', CAST(l.l_suppkey AS STRING), '-',
         CAST(p.p_size % 12 AS STRING)) AS raw_sku,
  p.p_name AS model_no, p.p_type AS product_name, p.p_brand AS brand,
  CAST(p.p_retailprice AS DECIMAL(12,2)) AS mrp,
  CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(3,2)) AS cost,
  l.l_shipdate AS load_ts
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN supplier s ON l.l_suppkey=s.s_suppkey
JOIN nation sn ON s.s_nationkey=sn.n_nationkey JOIN region sr ON sn.n_regionkey=sr.r_regionkey
JOIN part p ON l.l_partkey=p.p_partkey
"""

VENDOR_COST_SHEET = """
SELECT p_name AS style_name, p_type AS collection_name, p_brand AS brand,
  CAST(p_retailprice AS DECIMAL(12,2)) AS mrp,
  CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(3,2)) AS final_price FROM part
"""

PAYMENT_CYCLE = """
SELECT s.s_name AS party_name, n.n_name AS asm_name, s.s_suppkey % 50 AS margin,
  s.s_suppkey % 7 AS cd, s.s_suppkey % 61 AS payment_cycle
FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey
"""

STATUS_CASE = """CASE WHEN NULLIF(TRIM(order_status),'') IS NULL THEN 'UNKNOWN'
      ELSE CASE UPPER(TRIM(order_status)) WHEN 'CONFIRMED' THEN 'Confirmed' WHEN 'SHIPPED' THEN 'Shipped'
        WHEN 'MANIFEST SCANNED' THEN 'Manifest Scanned' WHEN 'CANCELLED' THEN 'Cancelled'
        WHEN 'OPEN' THEN 'Open' WHEN 'RETURNED' THEN 'Returned' ELSE TRIM(order_status) END END"""


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def history(start: str = "1995-01-01 00:00:00", end: str = "2001-12-31 23:59:59", where: str = "",
            name: str = "e") -> str:
    """CTE list ending in ``{name}``: enriched history rows inside [start, end]."""
    extra = f" AND ({where})" if where else ""
    return f"""ol AS ({ORDER_LINES}),
{name}_h AS (
  SELECT order_id, line_no, order_date, CAST(total_amount AS DECIMAL(18,4)) AS total_amount, item_quantity,
    COALESCE(NULLIF(UPPER(TRIM(payment_mode)),''),'UNKNOWN') AS payment_mode,
    {STATUS_CASE} AS order_status,
    COALESCE(NULLIF(TRIM(state),''),'UNKNOWN') AS state,
    order_type, marketplace, courier, import_warehouse_name, sku, model_no, model_no AS suborder_model_no,
    NULLIF(regexp_extract(sku, '_([^_]*)$', 1), '') AS size,
    pin_code, raw_sku,
    product_name, brand, mrp, cost,
    COALESCE(regexp_replace(NULLIF(TRIM(sku),''),'^YCE_',''),'UNKNOWN') AS canonical_sku_normalized
  FROM ol WHERE order_date IS NOT NULL AND order_date BETWEEN {ts(start)} AND {ts(end)}{extra}),
{name} AS (
  SELECT *,
    COALESCE(NULLIF(TRIM(regexp_extract(canonical_sku_normalized,'_([^_]*)$',1)),''),'UNKNOWN') AS size_bucket,
    regexp_replace(canonical_sku_normalized,'_[^_]*$','') AS base_sku,
    CAST(order_date AS DATE) AS order_date_only,
    isodow(order_date) - 1 AS day_of_week,
    strftime(order_date, '%a') AS day_label,
    hour(order_date) AS hour_of_day,
    CAST(date_trunc('week', order_date) AS DATE) AS week_start,
    CAST(date_trunc('month', order_date) AS DATE) AS month_start
  FROM {name}_h)"""


def money(expr: str) -> str:
    """Exact decimal rounded to cents, as DOUBLE."""
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def dround(expr: str, scale: int = 2) -> str:
    return f"ROUND({expr}, {scale})"


def _split_args(body: str) -> tuple[str, str] | None:
    depth, quote, last = 0, False, -1
    for i, ch in enumerate(body):
        if ch == "'":
            quote = not quote
        elif not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                last = i
    return None if last < 0 else (body[:last], body[last + 1:])


def spark_rounding(sql: str) -> str:
    """Rewrite every ``ROUND(x, s)`` to round the way Spark rounds a double: half-up on the
    value's shortest decimal text (which DuckDB's VARCHAR cast also produces). Exact
    decimals are unchanged by the detour; the result is DOUBLE like Spark's."""
    out, i = [], 0
    while True:
        j = sql.find("ROUND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, quote = j + len("ROUND("), 1, False
        while depth:
            ch = sql[k]
            if ch == "'":
                quote = not quote
            elif not quote:
                depth += 1 if ch == "(" else -1 if ch == ")" else 0
            k += 1
        body = sql[j + len("ROUND("):k - 1]
        parts = _split_args(body)
        if parts is None:
            out.append("ROUND(" + spark_rounding(body) + ")")
        else:
            expr, scale = spark_rounding(parts[0]), parts[1].strip()
            out.append(f"CAST(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {scale}) AS DOUBLE)")
        i = k


def ratio(n: str, d: str, scale: int = 2) -> str:
    return dround(f"COALESCE(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0), 0.0)", scale)


def pct(n: str, d: str) -> str:
    """Safe percent (unrounded)."""
    return f"COALESCE(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * 100.0, 0.0)"


def growth(cur: str, prev: str) -> str:
    return (f"(CASE WHEN COALESCE({prev},0) = 0 THEN (CASE WHEN COALESCE({cur},0) = 0 THEN 0.0 ELSE 100.0 END) "
            f"ELSE (CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / CAST({prev} AS DOUBLE) * 100.0 END)")


def bucket(grain: str, col: str = "order_date") -> str:
    if grain == "daily":
        return f"CAST({col} AS DATE)"
    return f"CAST(date_trunc('{'week' if grain == 'weekly' else 'month'}', {col}) AS DATE)"


def label(grain: str, col: str = "b") -> str:
    if grain == "daily":
        return f"strftime({col}, '%Y-%m-%d')"
    if grain == "weekly":
        return f"strftime({col}, '%b %d') || ' - ' || strftime({col} + INTERVAL 6 DAY, '%b %d')"
    return f"strftime({col}, '%b %Y')"
