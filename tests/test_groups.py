"""Group comparison (X1–X7) on hand-made frames: overlap, operator form (Q26), tie rules."""

from orderlens.operators import groups as X


def _orders(spark):
    return spark.createDataFrame([
        ("1", "COD", "B2B", "100"), ("2", "cod", "B2C", "50"), ("3", "PrePaid", "B2B", "50"), ("4", None, "B2C", "bad"),
    ], "order_id string, payment_mode string, order_type string, total_amount string")


def test_overlapping_groups_and_operator_form(spark):
    groups = [{"group_id": "cod", "filters": {"payment_mode": "COD"}},
              {"group_id": "b2b", "filters": {"order_type": {"operator": "in", "value": ["B2B"]}}},
              {"group_id": "big", "filters": {"total_amount": {"operator": "contains", "value": "10"}}}]
    tagged = X.assign_groups(_orders(spark), groups)
    got = sorted((r.group_id, r.order_id) for r in tagged.collect())
    assert got == [("b2b", "1"), ("b2b", "3"), ("big", "1"), ("cod", "1"), ("cod", "2")]   # order 1 in three groups


def test_metrics_and_tie_rules(spark):
    groups = [{"group_id": "a", "filters": {"order_type": "B2B"}}, {"group_id": "b", "filters": {"order_type": "B2C"}}]
    m = X.group_order_metrics(X.assign_groups(_orders(spark), groups))
    rows = {r.group_id: r for r in m.collect()}
    assert (rows["a"]["count"], rows["a"].total_revenue, rows["a"].avg_order_value) == (2, 150.0, 75.0)
    assert (rows["b"]["count"], rows["b"].total_revenue) == (2, 50.0)      # malformed amount counts as 0
    pair = {r.group_id: r for r in X.compare_groups(m, ["count", "total_revenue"], 2).collect()}
    assert pair["b"].count_winner and not pair["a"].count_winner          # pairwise: tie goes to the second group
    assert pair["a"].total_revenue_winner
    assert pair["b"].total_revenue_diff == -100.0 and pair["b"].total_revenue_diff_pct == -66.67
    multi = {r.group_id: r for r in X.compare_groups(m, ["count"], 3).collect()}
    assert multi["a"].count_winner and not multi["b"].count_winner        # N groups: the first listed wins ties


def test_payment_cycle_groups_hold_their_own_distributions(spark):
    sheet = spark.createDataFrame([("a", "30", "10", "2"), ("a", "40", "50", "4"), ("b", "x", "20", None), ("b", "10", "45", "1")],
                                  "party_name string, margin string, payment_cycle string, cd string")
    groups = [{"group_id": "a", "filters": {"party_name": "a"}},
              {"group_id": "long", "filters": {"payment_cycle": {"operator": "gte", "value": 20}}}]
    rows = {r.group_id: r for r in X.group_payment_cycle_metrics(X.assign_groups(sheet, groups)).collect()}
    hist = ("very_short_cycle_0_15", "short_cycle_15_30", "medium_cycle_30_45", "long_cycle_45plus")
    assert [rows["a"][c] for c in hist] == [1, 0, 0, 1] and [rows["long"][c] for c in hist] == [0, 1, 0, 2]
    assert (rows["a"].cd_sum, rows["a"].cd_max, rows["a"].cd_count, rows["a"].high_risk_count) == (6.0, 4.0, 2, 1)
    assert (rows["long"].cd_sum, rows["long"].cd_min, rows["long"].cd_count, rows["long"].avg_margin) == (5.0, 1.0, 2, 25.0)


def test_comparison_computes_the_metrics_once(spark):
    groups = [{"group_id": g, "filters": {"order_type": g}} for g in ("B2B", "B2C", "none")]
    m = X.compare_groups(X.group_order_metrics(X.assign_groups(_orders(spark), groups)), ["count", "total_revenue"], 3)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert X.compare_groups(X.group_order_metrics(X.assign_groups(_orders(spark).limit(0), groups)), ["count"], 3).count() == 0
