"""Time buckets (A7, A8) and growth series (A10)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import bucket_label

GRAIN_ALIASES = {"day": "daily", "daily": "daily", "week": "weekly", "weekly": "weekly",
                 "month": "monthly", "monthly": "monthly"}
# Fixed thresholds (days): history charts ≤31 daily, ≤180 weekly; posted-order
# charts ≤7 daily, ≤90 weekly; else monthly.
HISTORY_THRESHOLDS = (31, 180)
POSTED_THRESHOLDS = (7, 90)


def grain_for_days(days: int, thresholds: tuple[int, int] = HISTORY_THRESHOLDS) -> str:
    if days <= thresholds[0]:
        return "daily"
    if days <= thresholds[1]:
        return "weekly"
    return "monthly"


def requested_grain(value: str | None) -> str | None:
    if value is None:
        return None
    key = str(value).strip().lower()
    if key not in GRAIN_ALIASES:
        raise ValueError("Invalid granularity. Use day/week/month")
    return GRAIN_ALIASES[key]


def grain_from_window(start: datetime, end: datetime) -> str:
    """A7 (request window): days counted inclusively."""
    return grain_for_days(max((end.date() - start.date()).days + 1, 1))


def grain_from_data(df: DataFrame, col: str = "order_date",
                    thresholds: tuple[int, int] = HISTORY_THRESHOLDS) -> Column:
    """A7/A8 (observed span): whole 24 h periods between min and max.

    One global min/max aggregate, a scalar subquery of the plan that uses it: nothing runs before the action.
    """
    days = F.floor(df.agg(F.expr(f"timestampdiff(SECOND, min({col}), max({col}))")).scalar() / 86400)
    return (F.when(days > thresholds[1], F.lit("monthly")).when(days > thresholds[0], F.lit("weekly"))
            .otherwise(F.lit("daily")))


def bucket_start(grain: str | Column, col: str | Column = "order_date") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(grain, Column):
        return (F.when(grain == "daily", bucket_start("daily", c)).when(grain == "weekly", bucket_start("weekly", c))
                .otherwise(bucket_start("monthly", c)))
    if grain == "daily":
        return F.to_date(c)
    if grain == "weekly":
        return F.to_date(F.date_trunc("week", c))
    if grain == "monthly":
        return F.to_date(F.date_trunc("month", c))
    raise ValueError(f"unknown grain {grain!r}")


def with_bucket(df: DataFrame, grain: str | Column, col: str = "order_date") -> DataFrame:
    """Adds ``_bucket`` (date) for grouping; rows with a null date drop."""
    return df.where(F.col(col).isNotNull()).withColumn("_bucket", bucket_start(grain, col))


def finish_series(agg: DataFrame, grain: str | Column) -> DataFrame:
    """Replace ``_bucket`` by the ``bucket`` key (yyyy-MM-dd) and its chart ``label``; rows come by bucket."""
    return (agg.withColumn("bucket", F.date_format("_bucket", "yyyy-MM-dd"))
            .withColumn("label", bucket_label(F.col("_bucket"), grain))
            .drop("_bucket").orderBy("bucket"))


def growth_series(value: str, order_col: str = "bucket", partition: list[str] | None = None) -> Column:
    """A10: growth % vs the previous bucket present.

    First bucket → null; 0 after 0 → 0; any value after 0 → null; else rounded
    to 2 places. The window runs over already-aggregated buckets (one row per
    bucket and series key), never over raw rows.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(order_col)
    prev = F.lag(F.col(value).cast("double")).over(w)
    cur = F.col(value).cast("double")
    return (F.when(prev.isNull(), F.lit(None).cast("double"))
            .when(prev == 0, F.when(cur == 0, F.lit(0.0)).otherwise(F.lit(None).cast("double")))
            .otherwise(F.round((cur - prev) / prev * 100.0, 2)))
