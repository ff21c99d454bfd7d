"""Exact quantiles by value bins (functions/quantiles.py) against Spark's single-buffer percentile,
with few and many bins and one value holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from orderlens.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.333, 0.5, 0.75, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("accuracy", [50, 1000, 1_000_000])
def test_matches_percentile_with_hot_value(spark, accuracy):
    n = 9000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(42.5))                       # a third of the rows share one value
        .otherwise((F.col("id") * 7919 % 1000) / 10.0 + F.col("id") % 7).alias("x"))
    got = exact_quantiles(df, F.col("x"), PROBS, accuracy=accuracy)
    row = df.agg(*[F.percentile("x", F.lit(p)).alias(f"p{i}") for i, p in enumerate(PROBS)],
                 *[got[p].alias(f"q{i}") for i, p in enumerate(PROBS)]).first()
    for i, p in enumerate(PROBS):
        assert row[f"q{i}"] == pytest.approx(row[f"p{i}"], rel=0, abs=1e-9), p


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert df.agg(exact_quantiles(df, F.col("x"), [0.5])[0.5].alias("q")).first().q is None
    df2 = spark.createDataFrame([(None,), (3.0,), (1.0,)], "x double")
    assert df2.agg(exact_quantiles(df2, F.col("x"), [0.5])[0.5].alias("q")).first().q == 2.0
