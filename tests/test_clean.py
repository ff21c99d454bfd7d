"""Cleaning rules (C5–C26) on hand-made rows: nulls, blanks, prefixes, sizes, growth edge cases."""

from datetime import datetime

from pyspark.sql import functions as F

from orderlens.functions import clean as C


def _rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_enrich_labels_and_skus(spark):
    df = _rows(spark, [
        (" cod ", "cancelled", " Goa ", "YCE_100_9", None, None, datetime(2026, 2, 17, 8, 53, 40)),
        ("", " RTO ", "", "  ", "ABC_7", None, datetime(2026, 2, 16, 0, 0, 0)),
        (None, None, None, None, None, "XL", datetime(2026, 2, 22, 23, 0, 0)),
    ], "payment_mode string, order_status string, state string, sku string, marketplace_sku string, "
       "size string, order_date timestamp_ntz")
    for c in ("canonical_sku", "suborder_sku", "suborder_marketplace_sku", "suborder_size"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = {r["order_date"].day: r for r in C.enrich(df).collect()}
    a, b, c = out[17], out[16], out[22]
    assert (a.payment_mode, a.order_status, a.state) == ("COD", "Cancelled", "Goa")
    assert (a.canonical_sku_normalized, a.size_bucket, a.base_sku) == ("100_9", "9", "100")
    assert (b.payment_mode, b.order_status, b.state) == ("UNKNOWN", "RTO", "UNKNOWN")
    assert (b.canonical_sku_normalized, b.size_bucket, b.base_sku) == ("ABC_7", "7", "ABC")
    assert (c.payment_mode, c.order_status, c.canonical_sku_normalized, c.size_bucket) == ("UNKNOWN", "UNKNOWN", "UNKNOWN", "XL")
    assert (a.day_of_week, a.day_label, a.hour_of_day) == (1, "Tue", 8)      # Monday = 0
    assert str(a.week_start) == "2026-02-16" and str(a.month_start) == "2026-02-01"
    assert c.day_label == "Sun" and str(c.week_start) == "2026-02-16"


def test_parse_raw_sku(spark):
    cases = [("10400-120-7", "10400-120", "7"), ("ABC-10421-115-9", "10421-115", "9"),
             ("ABC-DEF", "ABC-DEF", ""), ("12345", "12345", ""), (" XY-1-2 ", "1", "2")]
    df = _rows(spark, [(c[0],) for c in cases], "raw string")
    base, size = C.parse_raw_sku("raw")
    got = {r.raw: (r.b, r.s) for r in df.select("raw", base.alias("b"), size.alias("s")).collect()}
    for raw, b, s in cases:
        assert got[raw] == (b, s), raw


def test_growth_and_safe_pct(spark):
    df = _rows(spark, [(0.0, 0.0), (5.0, 0.0), (15.0, 10.0), (None, 3.0)], "cur double, prev double")
    got = [r.g for r in df.select(F.round(C.growth_pct(F.col("cur"), F.col("prev")), 2).alias("g")).collect()]
    assert got[:3] == [0.0, 100.0, 50.0]
    pct = df.select(C.safe_pct(F.col("cur"), F.col("prev")).alias("p")).collect()
    assert pct[0].p == 0.0 and pct[1].p == 0.0 and pct[2].p == 150.0


def test_numeric_coercion_and_first_non_empty(spark):
    df = _rows(spark, [("601.0001", "", " x "), ("bad", None, "y"), (None, "a", None)], "amt string, a string, b string")
    rows = df.select(C.to_number("amt").alias("n"), C.first_non_empty("a", "b").alias("f")).collect()
    assert [float(r.n) for r in rows] == [601.0001, 0.0, 0.0]
    assert [r.f for r in rows] == ["x", "y", "a"]


def test_bucket_labels(spark):
    df = _rows(spark, [(datetime(2026, 2, 3),)], "d timestamp_ntz").select(F.to_date("d").alias("d"))
    r = df.select(*[C.bucket_label(F.col("d"), g).alias(g) for g in ("daily", "weekly", "monthly")]).first()
    assert (r.daily, r.weekly, r.monthly) == ("2026-02-03", "Feb 03 - Feb 09", "Feb 2026")
