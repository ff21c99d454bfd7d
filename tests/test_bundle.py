"""The bundle's cells against the single metrics, on rows without ids, odd spellings, wide amounts and no rows."""

import statistics
from datetime import datetime

import pytest

from orderlens.operators import bundle, kpis, metrics
from orderlens.plans.catalog import fetched
from orderlens.plans.history import fetch

from paths import SF_SMALL
from test_edge_cases import REQ, history_of

D = datetime(2026, 3, 1, 10)
ROWS = [
    (1, D, "100.5", 1, "Cancelled", "cod", "Goa", "A_1"), (1, D, "50", 2, "Shipped", "COD", "Goa", " A_1"),
    (2, D, "bad", 3, "RTO", None, "", "B_8"), (None, D, "7", 4, "Cancelled", "COD", "Goa", "B_8"),
    (None, D, "7", 4, "Cancelled", "COD", "Goa", "B_8"), (3, datetime(2026, 5, 2), "1000000.0001", 0, None, "x", "Kerala", None),
    (3, datetime(2026, 5, 2), "1000000.0003", 0, "Returned", "x", "Kerala", "  ")]


def long_rows(df):
    return {(r.category, r.metric, r.key): r.value for r in df.collect()}


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[3:5]], ids=["mixed", "empty", "without ids"])
def test_cells_equal_the_single_metrics(spark, rows):
    df = fetch(history_of(spark, rows), REQ)
    got = long_rows(bundle.batch_all_metrics(df))
    for name, value in kpis.kpi_bundle(df).first().asDict().items():
        assert got["primary", name, None] == value, name
    assert got["product", "sku_diversity_index", None] == metrics.sku_diversity_index(df).first().value
    lists = {"top_skus_by_revenue": (metrics.top_skus_by_revenue(df, 5), "revenue"),
             "top_skus_by_units": (metrics.top_skus_by_units(df, 5), "units"),
             "sku_performance_revenue": (metrics.sku_performance_matrix(df, 10), "revenue")}
    for metric, (plain, value) in lists.items():
        assert {k[2]: v for k, v in got.items() if k[1] == metric} == {r.sku: float(r[value]) for r in plain.collect()}
    rates = {r.state: r.cancellation_rate for r in metrics.state_cancellation_rates(df).collect() if r.cancellation_rate}
    assert {k[2]: v for k, v in got.items() if k[1] == "state_cancellation_rate"} == rates
    amounts = [float(r.total_amount) for r in df.collect()]
    std = got["performance", "order_value_std", None]
    assert std == (round(statistics.stdev(amounts), 2) if amounts else None)
    assert len([k for k in got if k[1] == "monthly_orders"]) == len({r.order_date.month for r in df.collect()})


def test_a_small_spread_about_a_large_mean(spark):
    """Exact squares: plain doubles would lose the spread."""
    rows = [(i, D, f"99999999999.{i}", 1, "Open", "COD", "Goa", "A_1") for i in range(1, 9)]
    df = fetch(history_of(spark, rows), REQ)
    std = bundle.totals(bundle.bundle_cells(df, "performance")).first().amt_std
    assert std == pytest.approx(statistics.stdev([i / 10 for i in range(1, 9)]), rel=1e-9)


def test_one_scan_and_one_shuffle_of_rows(spark):
    """Rows are read once and dealt once, by order; the per-order step needs no shuffle of its own."""
    df = fetched(spark, SF_SMALL, extra_cols=("size",))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    count = lambda text, word: text.count(word)
    made = plan(bundle.cells_of(df, tuple(dict.fromkeys(d for c in bundle.DIMS.values() for d in c))))
    assert count(made, "FileScan") == count(plan(df), "FileScan")
    assert count(made, "Exchange") == count(plan(df), "Exchange") + 2
    # the bundle itself reads the cells alone (the median is fixed before)
    files = bundle.batch_all_metrics(df).inputFiles()
    assert files and all("orderlens-bundle" in f for f in files)
