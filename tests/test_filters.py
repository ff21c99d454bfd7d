"""Filter compiler (F1–F8): operator semantics, nested any-match, request bounds."""

import pytest
from pyspark.sql import functions as F

from orderlens.functions import filters as FL
from orderlens.plans.request import HistoryRequest


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([
        ("1", "COD", 5, "Goa", [("A_1", "10", "x")]),
        ("2", "PrePaid", None, None, [("B_2", "abc", "y"), ("C_3", "20", "z")]),
        ("3", None, 12, "goa ", []),
    ], "order_id string, payment_mode string, qty int, state string, "
       "suborders array<struct<sku:string,mrp:string,size:string>>")


def ids(df):
    return sorted(r.order_id for r in df.select("order_id").collect())


def test_top_level_operators(orders):
    assert ids(FL.apply_filters(orders, [{"field": "payment_mode", "value": "cod"}])) == ["1"]
    assert ids(FL.apply_filters(orders, [{"field": "payment_mode", "operator": "ne", "value": "COD"}])) == ["2", "3"]
    assert ids(FL.apply_filters(orders, [{"field": "qty", "operator": "lt", "value": 6}])) == ["1", "2"]  # missing → 0
    assert ids(FL.apply_filters(orders, [{"field": "payment_mode", "operator": "contains", "value": "PAID"}])) == ["2"]
    assert ids(FL.apply_filters(orders, [{"field": "state", "operator": "in", "value": ["Goa"]}])) == ["1"]
    with pytest.raises(ValueError):
        FL.apply_filters(orders, [{"field": "qty", "operator": "between", "value": 1}])


def test_nested_any_match(orders):
    nested = ["sku", "mrp", "size"]
    assert ids(FL.apply_filters(orders, [{"field": "mrp", "operator": "gt", "value": 15}], nested)) == ["2"]
    assert ids(FL.apply_filters(orders, [{"field": "mrp", "value": "ABC"}], nested)) == ["2"]   # text fallback per cell
    assert ids(FL.apply_filters(orders, [{"field": "mrp", "value": 10}], nested)) == ["1"]      # numeric per cell
    assert ids(FL.apply_filters(orders, [{"field": "sku", "operator": "contains", "value": "c_"}], nested)) == ["2"]
    assert ids(FL.apply_filters(orders, [{"field": "size", "operator": "in", "value": ["y", "x"]}], nested)) == ["1", "2"]


def test_dimension_and_date_filters(spark):
    from datetime import datetime
    df = spark.createDataFrame([
        (datetime(2026, 1, 31, 23, 59, 59), " Myntra "), (datetime(2026, 2, 1, 0, 0, 0), "AJIO"),
        (None, "myntra")], "order_date timestamp_ntz, marketplace string")
    req = HistoryRequest("2026-01-01", "2026-01-31", {"marketplace": ["MYNTRA", " "], "payment_mode": "ignored"})
    assert req.end == datetime(2026, 1, 31, 23, 59, 59)
    got = df.where(FL.history_filter(req.start, req.end, req.filters)).collect()
    assert len(got) == 1 and got[0].marketplace == " Myntra "
    days = df.where(FL.day_match(["2026-02-01"])).collect()
    assert len(days) == 1 and days[0].marketplace == "AJIO"


def test_state_equals_drops_missing(spark):
    df = spark.createDataFrame([("Goa", "1"), ("GOA", None), (None, "2")], "state string, pin_code string")
    assert df.where(FL.state_equals("goa")).count() == 1
