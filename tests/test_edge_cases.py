"""§1.4 edge cases on hand-made frames: empty input, zero denominators, ties, constant columns."""

from datetime import datetime

from orderlens.operators import charts, kpis, metrics, stats
from orderlens.plans.history import fetch
from orderlens.plans.request import HistoryRequest
from orderlens.schema import HISTORY_COLUMNS, HISTORY_TYPES
from orderlens.sources.history import conform

REQ = HistoryRequest("2026-01-01", "2026-12-31")


def history_of(spark, rows):
    cols = ["order_id", "order_date", "total_amount", "item_quantity", "order_status", "payment_mode", "state", "sku"]
    df = spark.createDataFrame(rows, "order_id long, order_date timestamp_ntz, total_amount string, item_quantity long, "
                                     "order_status string, payment_mode string, state string, sku string")
    return conform(df.select(*cols), HISTORY_TYPES).select(*HISTORY_COLUMNS)


def test_kpi_bundle_empty_input(spark):
    df = fetch(history_of(spark, []), REQ)
    r = kpis.kpi_bundle(df).first()
    assert r.total_orders == 0 and r.units_sold == 0 and r.gross_revenue == 0.0 and r.aov == 0.0
    assert r.cancellation_rate == 0.0 and r.cod_share == 0.0


def test_kpi_bundle_distinct_orders_and_rows(spark):
    d = datetime(2026, 3, 1, 10)
    rows = [(1, d, "100.5", 1, "Cancelled", "cod", "Goa", "YCE_1_9"), (1, d, "50", 2, "Shipped", "COD", "Goa", "1_9"),
            (2, d, "bad", 3, "RTO", None, "", "2_8")]
    r = kpis.kpi_bundle(fetch(history_of(spark, rows), REQ)).first()
    assert r.total_orders == 2 and r.units_sold == 6 and r.gross_revenue == 150.5 and r.aov == 75.25
    assert r.unique_skus == 3 and r.cancellation_rate == 50.0 and r.return_rate == 50.0
    assert r.cod_share == 66.67 and r.delivered_rate == 0.0


def test_top_n_ties_are_deterministic(spark):
    d = datetime(2026, 3, 1)
    rows = [(i, d, "10", 1, "Open", "COD", s, f"{k}_1") for i, (s, k) in enumerate(
        [("B", "b"), ("A", "a"), ("C", "c"), ("A", "a"), ("B", "b"), ("C", "c")])]
    df = fetch(history_of(spark, rows), REQ)
    top = [r.canonical_sku for r in charts.top_skus_units(df, 2).collect()]
    assert top == ["a_1", "b_1"]
    states = [r.state for r in metrics.top_states_by_revenue(df, 2).collect()]
    assert sorted(states) == ["A", "B"]


def test_single_row_std_and_constant_correlation(spark):
    d = datetime(2026, 3, 1)
    df = history_of(spark, [(1, d, "10", 1, "Open", "COD", "A", "a_1")])
    s = stats.statistical_summary(df, "total_amount").first()
    assert s["count"] == 1 and s["std"] == 0.0
    two = history_of(spark, [(1, d, "10", 1, "Open", "COD", "A", "a_1"), (2, d, "20", 1, "Open", "COD", "A", "a_1")])
    corr = {(r.field_a, r.field_b): r.corr for r in stats.correlation_matrix(two, ["total_amount", "item_quantity"]).collect()}
    assert corr[("total_amount", "total_amount")] == 1.0
    assert corr[("total_amount", "item_quantity")] is None        # zero variance → null, no ANSI error


def test_custom_metric_checks(spark):
    import pytest
    df = history_of(spark, [(1, datetime(2026, 3, 1), "10", 1, "Open", "COD", "A", "a_1")])
    assert stats.custom_metric(df, "sum(total_amount) * 2", "double_rev").first()["double_rev"] == 20
    with pytest.raises(ValueError):
        stats.custom_metric(df, "sum(total_amount)", "bad name")
    with pytest.raises(Exception):
        stats.custom_metric(df, "max(order_status) filter (where false)", "nothing").collect()


def test_heatmap_is_dense(spark):
    df = fetch(history_of(spark, [(1, datetime(2026, 3, 2, 5), "1", 1, "Open", "COD", "A", "a_1")]), REQ)
    cells = charts.order_intensity_heatmap(df).collect()
    assert len(cells) == 168 and sum(c.order_count for c in cells) == 1
    hit = [c for c in cells if c.order_count == 1][0]
    assert (hit.day_of_week, hit.hour) == ("Mon", 5)
