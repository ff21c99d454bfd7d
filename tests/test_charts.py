"""Chart grids and series totals on hand-made frames; no job before the action."""

from datetime import datetime

from orderlens.operators import charts, posted, stats


def test_size_grid_is_dense_and_ranked(spark):
    df = spark.createDataFrame([("a", "S", 1), ("a", "M", 2), ("b", "L", 9), ("b", "S", None), ("c", "XL", 1)],
                               "base_sku string, size_bucket string, item_quantity long")
    rows = charts.top_base_sku_size_distribution(df, 2).collect()
    assert sorted((r.y_index, r.x_index, r.base_sku, r["size"], r.units) for r in rows) == [
        (0, 0, "b", "L", 9.0), (0, 1, "b", "M", 0.0), (0, 2, "b", "S", 0.0),
        (1, 0, "a", "L", 0.0), (1, 1, "a", "M", 2.0), (1, 2, "a", "S", 1.0)]
    assert {(r.base_sku, r["size"]): r.share_pct for r in rows}["a", "M"] == 66.67
    cells = {(r.base_sku, r["size"]): r.x_index for r in charts.base_sku_size_heatmap(df, 2).collect()}
    assert cells == {("b", "L"): 0, ("b", "S"): 2, ("a", "M"): 1, ("a", "S"): 2}


def _docs(spark, days):
    subs = "suborders array<struct<sku:string>>"
    return spark.createDataFrame([(d, "10", m, [(s,) for s in skus] if skus is not None else None) for d, m, skus in days],
                                 f"order_date string, total_amount string, payment_mode string, {subs}")


def test_series_totals_count_distinct_skus_once(spark):
    docs = _docs(spark, [("2024-01-01 10:00:00", "COD", ["x", "y"]), ("2024-01-01 11:00:00", "PrePaid", ["x", ""]),
                         ("2024-01-03 09:00:00", None, ["x", "z", None]), ("2024-01-03", "COD", None), ("bad", "COD", ["q"])])
    rows = posted.volume_chart(docs).collect()
    assert [(r.bucket, r.label, r.grain, r.order_count, r.unique_sku_count, r.is_total) for r in rows] == [
        ("2024-01-01", "Mon", "daily", 2, 2, False), ("2024-01-03", "Wed", "daily", 2, 2, False), (None, "total", "daily", 4, 3, True)]
    assert [(r.revenue, r.orders, r.aov) for r in posted.revenue_chart(docs).collect()][-1] == (40.0, 4, 10.0)
    assert [(r.cod, r.prepaid) for r in posted.payment_chart(docs).collect()][-1] == (2, 1)
    assert posted.volume_chart(docs.limit(0)).count() == 0


def test_planning_a_chart_runs_no_job(spark):
    docs = _docs(spark, [("2024-01-01 10:00:00", "COD", ["x"]), ("2024-09-01 10:00:00", "COD", ["x"])])
    group = "planning-a-chart"
    spark.sparkContext.setJobGroup(group, group)
    try:
        chart = posted.volume_chart(docs)
        lines = spark.createDataFrame([(datetime(2024, 1, 1), 1), (datetime(2024, 2, 20), 2)], "order_date timestamp_ntz, order_id long")
        from orderlens.plans.request import HistoryRequest
        line = charts.orders_line(lines, HistoryRequest("2024-01-01", "2024-12-31"))
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.label for r in chart.collect()] == ["Jan 2024", "Sep 2024", "total"]
    assert {r.grain for r in line.collect()} == {"weekly"}


def test_profile_lists_top_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", 3, None), (None, 3, None)], "k string, n long, e string")
    rows = {r.column: r for r in stats.column_profile(df, top=2).collect()}
    assert rows["k"].top_values == "b (2); a (1)" and rows["n"].top_values == "3 (2); 1 (1)"
    assert (rows["n"].distinct_count, rows["n"].non_null, rows["n"].example) == (3, 4, "1")
    assert (rows["e"].non_null, rows["e"].distinct_count, rows["e"].top_values) == (0, 0, None)
    assert {(r.column, r.value, r.n) for r in stats.column_values(df).collect()} == {
        ("k", "a", 1), ("k", "b", 2), ("n", "1", 1), ("n", "2", 1), ("n", "3", 2)}


def test_profile_has_every_value(spark):
    """More values than the most frequent ones: each has its row; a column of nulls has one row without a value."""
    df = spark.createDataFrame([(f"v{i:02d}", None) for i in range(30)] + [("v07", None)], "k string, e string")
    rows = stats.column_profile(df).collect()
    assert {(r.value, r.n) for r in rows if r.column == "k"} == {(f"v{i:02d}", 1 + (i == 7)) for i in range(30)}
    assert {(r.non_null, r.distinct_count, r.is_categorical) for r in rows if r.column == "k"} == {(31, 30, False)}
    assert [(r.value, r.n, r.non_null) for r in rows if r.column == "e"] == [(None, 0, 0)]
