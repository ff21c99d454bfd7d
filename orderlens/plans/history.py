"""History fetch plan — projection, coercion, request filters, enrichment.

``fetch`` is the one entry every history operator starts from:

    scan(history) → select(22 cols) → coerce numbers → where(date & dims) → enrich

The projection and the date/dimension predicate reach the Parquet scan
(column pruning, pushed filters, month-partition pruning on the written
history table). ``fetch_two_windows`` reads both comparison windows in a
single scan and tags each row with its window.
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import enrich, to_number
from ..functions.filters import date_range, history_filter
from ..schema import HISTORY_COLUMNS
from .request import HistoryRequest

NUMERIC = ["total_amount", "item_quantity", "suborder_quantity", "order_quantity"]


def _coerce(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    cols = {}
    for c in NUMERIC:
        if c in types:
            target = "decimal(18,4)" if c == "total_amount" else "bigint"
            if types[c] == "string":
                cols[c] = to_number(c, target)
            else:
                cols[c] = F.coalesce(F.col(c).cast(target), F.lit(0).cast(target))
    return df.withColumns(cols)


def month_bounds(start: datetime | None, end: datetime | None) -> Column:
    """The ``order_month`` range implied by a date window: prunes whole month folders."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("order_month") >= F.lit(start.strftime("%Y-%m")))
    if end is not None:
        cond = cond & (F.col("order_month") <= F.lit(end.strftime("%Y-%m")))
    return cond


def fetch(history: DataFrame, req: HistoryRequest, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Filtered, enriched history rows for one request window."""
    cols = [c for c in dict.fromkeys([*HISTORY_COLUMNS, *extra_cols]) if c in history.columns]
    cond = history_filter(req.start, req.end, req.filters)
    if "order_month" in history.columns:
        cond = cond & month_bounds(req.start, req.end)
    df = history.where(cond).select(*cols)
    return enrich(_coerce(df))


def _bounds(d0: date, d1: date) -> tuple[datetime, datetime]:
    return datetime.combine(d0, time(0, 0, 0)), datetime.combine(d1, time(23, 59, 59))


def fetch_two_windows(history: DataFrame, req: HistoryRequest, cur: tuple[date, date], prev: tuple[date, date],
                      extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the current and previous windows in one scan, tagged ``window``.

    A row in both windows (possible only when they overlap) is kept once per
    window, as two separate fetches would.
    """
    (cs, ce), (ps, pe) = _bounds(*cur), _bounds(*prev)
    wide = HistoryRequest(min(cs, ps).isoformat(sep=" "), max(ce, pe).isoformat(sep=" "), req.filters)
    base = fetch(history, wide, extra_cols)
    in_cur, in_prev = date_range(cs, ce), date_range(ps, pe)
    windows = F.filter(F.array(F.when(in_cur, F.lit("current")), F.when(in_prev, F.lit("previous"))),
                       lambda x: x.isNotNull())
    return base.withColumn("window", F.explode(windows))
