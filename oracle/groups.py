"""Oracle SQL for the group comparisons."""

from __future__ import annotations

from .base import PAYMENT_CYCLE, VENDOR_COST_SHEET
from .posted import BASE

ORDER_GROUP_SQL = [("cod", 0, "LOWER(COALESCE(payment_mode, '')) = 'cod'"),
                   ("prepaid", 1, "LOWER(COALESCE(payment_mode, '')) LIKE '%paid%'"),
                   ("b2b_building", 2, "LOWER(COALESCE(order_type, '')) = 'b2b' AND marketplace IN ('BUILDING')")]


def _assigned(groups) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{g}' AS group_id, {i} AS group_index, * FROM od WHERE {cond}" for g, i, cond in groups)


def _metrics(groups) -> str:
    return f"""{BASE}, ga AS ({_assigned(groups)}),
gm AS (SELECT group_id, group_index, COUNT(*) AS count,
         ROUND(CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_revenue,
         ROUND(CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 2) AS avg_order_value
       FROM ga GROUP BY 1, 2)"""


def _compare(cols, pairwise: bool, lower=()) -> str:
    parts = []
    for c in cols:
        base = f"(SELECT COALESCE(CAST({c} AS DOUBLE), 0.0) FROM gm WHERE group_index = (SELECT MIN(group_index) FROM gm))"
        v = f"COALESCE(CAST({c} AS DOUBLE), 0.0)"
        order = f"{v} ASC" if c in lower else f"{v} DESC"
        tie = "group_index DESC" if pairwise else "group_index ASC"
        parts.append(f"ROUND({v} - {base}, 4) AS {c}_diff, "
                     f"ROUND(CASE WHEN {base} > 0 THEN ({v} - {base}) / {base} * 100.0 ELSE 0.0 END, 2) AS {c}_diff_pct, "
                     f"ROW_NUMBER() OVER (ORDER BY {order}, {tie}) = 1 AS {c}_winner")
    return ", ".join(parts)


def queries() -> dict[str, str]:
    q = {}
    ocols = ["count", "total_revenue", "avg_order_value"]
    q["x1_group_assignment"] = f"{BASE}, ga AS ({_assigned(ORDER_GROUP_SQL)}) SELECT group_id, group_index, COUNT(*) AS orders FROM ga GROUP BY 1, 2"
    q["x2_group_order_metrics"] = f"{_metrics(ORDER_GROUP_SQL)} SELECT * FROM gm"
    dist = []
    for col in ("payment_mode", "order_status", "city", "billing_state"):
        expr = "'Unknown'" if col == "city" else ("COALESCE(state, 'Unknown')" if col == "billing_state" else f"COALESCE({col}, 'Unknown')")
        dist.append(f"SELECT group_id, '{col}' AS dimension, {expr} AS value, COUNT(*) AS count FROM ga GROUP BY 1, 3")
    q["x2_group_distributions"] = f"{BASE}, ga AS ({_assigned(ORDER_GROUP_SQL)})\n" + "\nUNION ALL\n".join(dist)
    q["x4_pairwise_order_comparison"] = f"{_metrics(ORDER_GROUP_SQL[:2])} SELECT *, {_compare(ocols, True)} FROM gm"
    q["x5_multi_group_order_comparison"] = f"{_metrics(ORDER_GROUP_SQL)} SELECT *, {_compare(ocols, False)} FROM gm"
    m, c = "CAST(mrp AS DOUBLE)", "CAST(final_price AS DOUBLE)"
    margin = f"(CASE WHEN {m} <> 0 THEN ({m} - {c}) / {m} * 100.0 ELSE 0.0 END)"
    markup = f"(CASE WHEN {c} <> 0 THEN ({m} - {c}) / {c} ELSE 0.0 END)"
    pg = [("brand1", 0, "LOWER(COALESCE(brand, '')) = 'brand#1'"), ("brand2", 1, "LOWER(COALESCE(brand, '')) = 'brand#2'"),
          ("premium", 2, "COALESCE(mrp, 0) >= 1500")]
    assigned = "\nUNION ALL\n".join(f"SELECT '{g}' AS group_id, {i} AS group_index, * FROM v WHERE {cond}" for g, i, cond in pg)
    q["x6_profit_group_comparison"] = f"""WITH v AS ({VENDOR_COST_SHEET}), ga AS ({assigned}),
it AS (SELECT group_id, group_index, ROUND({m} - {c}, 2) AS gross_profit, ROUND({margin}, 2) AS gross_margin,
         ROUND(ROUND({markup}, 4) * 100.0, 2) AS markup_percent FROM ga),
gm AS (SELECT group_id, COUNT(*) AS count, ROUND(COALESCE(AVG(gross_margin), 0), 2) AS avg_gross_margin,
         ROUND(COALESCE(AVG(markup_percent), 0), 2) AS avg_markup_percent, ROUND(SUM(gross_profit), 2) AS total_gross_profit,
         MIN(group_index) AS group_index FROM it GROUP BY 1)
SELECT *, {_compare(['avg_gross_margin', 'avg_markup_percent', 'total_gross_profit'], False)} FROM gm"""
    cg = [("asm1", 0, "LOWER(COALESCE(asm_name, '')) = 'nation_1'"), ("asm2", 1, "LOWER(COALESCE(asm_name, '')) = 'nation_2'"),
          ("high_margin", 2, "COALESCE(margin, 0) > 30")]
    assigned = "\nUNION ALL\n".join(f"SELECT '{g}' AS group_id, {i} AS group_index, * FROM pc WHERE {cond}" for g, i, cond in cg)
    mg, cy, cd = "CAST(margin AS DOUBLE)", "CAST(payment_cycle AS DOUBLE)", "CAST(cd AS DOUBLE)"
    cycle = f"""WITH pc AS ({PAYMENT_CYCLE}), ga AS ({assigned}),
gm AS (SELECT group_id, group_index, COUNT(*) AS distributor_count, ROUND(AVG({mg}), 2) AS avg_margin,
         ROUND(AVG({mg}), 2) AS weighted_avg_margin,
         ROUND(AVG(CASE WHEN {cy} > 0 THEN {mg} / {cy} END), 4) AS margin_per_payment_day,
         ROUND(AVG(CASE WHEN {cy} > 0 THEN (100 - {mg}) / {cy} END), 4) AS cycle_efficiency_score,
         ROUND(SUM({mg}), 2) AS total_margin_exposure,
         COUNT(CASE WHEN {cy} >= 0 AND {cy} < 15 THEN 1 END) AS very_short_cycle_0_15,
         COUNT(CASE WHEN {cy} >= 15 AND {cy} < 30 THEN 1 END) AS short_cycle_15_30,
         COUNT(CASE WHEN {cy} >= 30 AND {cy} < 45 THEN 1 END) AS medium_cycle_30_45,
         COUNT(CASE WHEN {cy} >= 45 THEN 1 END) AS long_cycle_45plus,
         ROUND(COALESCE(SUM({cd}), 0), 2) AS cd_sum, ROUND(COALESCE(AVG({cd}), 0), 2) AS cd_mean,
         ROUND(COALESCE(MAX({cd}), 0), 2) AS cd_max, ROUND(COALESCE(MIN({cd}), 0), 2) AS cd_min, COUNT({cd}) AS cd_count,
         COUNT(CASE WHEN {mg} > 30 AND {cy} > 45 THEN 1 END) AS high_risk_count FROM ga GROUP BY 1, 2)"""
    q["x3_payment_cycle_groups"] = f"{cycle} SELECT * FROM gm"
    q["x3_x7_payment_cycle_group_comparison"] = f"""{cycle}
SELECT *, {_compare(['avg_margin', 'margin_per_payment_day', 'high_risk_count'], False, lower=('high_risk_count',))} FROM gm"""
    return q
