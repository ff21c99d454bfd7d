"""Filters and predicates (F1–F10) compiled to Spark Columns.

Every filter is a plain ``Column`` so Catalyst can push it into the Parquet
scan (``PushedFilters``) and prune partitions where the column allows it.
"""

from __future__ import annotations

import functools
import operator
from datetime import datetime
from decimal import Decimal
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The dimension keys honoured by the history filter, and the
# control keys that are request options rather than filters.
HISTORY_FILTER_KEYS = ["order_date", "marketplace", "courier", "import_warehouse_name", "state"]
CONTROL_KEYS = ["sku_1", "sku_2", "window", "granularity", "top_n"]

OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "in")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_range(lo: datetime | None, hi: datetime | None, col: str = "order_date") -> Column:
    """inclusive on both ends; null dates never match."""
    cond = _c(col).isNotNull()
    if lo is not None:
        cond = cond & (_c(col) >= ts_literal(lo))
    if hi is not None:
        cond = cond & (_c(col) <= ts_literal(hi))
    return cond


def ts_literal(value: datetime) -> Column:
    """A zone-free timestamp literal (ISO text cast to timestamp_ntz; no session/OS zone shift)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _as_list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def dimension_match(col: str, value: Any) -> Column | None:
    """trimmed, case-insensitive equality / membership; empty → no filter."""
    allowed = [str(v).strip().lower() for v in _as_list(value) if v is not None and str(v).strip()]
    if not allowed:
        return None
    key = F.lower(F.trim(_c(col).cast("string")))
    return key == allowed[0] if len(allowed) == 1 and not isinstance(value, (list, tuple, set)) else key.isin(allowed)


def day_match(value: Any, col: str = "order_date") -> Column | None:
    """the order day (yyyy-MM-dd) is one of the given days."""
    days = [str(v).strip()[:10] for v in _as_list(value) if v is not None and str(v).strip()]
    if not days:
        return None
    return F.date_format(_c(col), "yyyy-MM-dd").isin(days)


def history_filter(start: datetime | None, end: datetime | None, filters: dict | None) -> Column:
    """F1 + F2 + F3: the history fetch predicate. Only the five known keys apply."""
    conds = [date_range(start, end)]
    for key in HISTORY_FILTER_KEYS:
        if not filters or key not in filters or filters[key] is None:
            continue
        c = day_match(filters[key]) if key == "order_date" else dimension_match(key, filters[key])
        if c is not None:
            conds.append(c)
    return functools.reduce(operator.and_, conds)


def strip_control_keys(filters: dict | None) -> dict:
    """remove request options from a filter dict."""
    return {k: v for k, v in (filters or {}).items() if k not in CONTROL_KEYS}


def _num(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def predicate(field: str, op: str, value: Any) -> Column:
    """one top-level predicate.

    Text ``eq`` / ``contains`` compare case-insensitively with a missing value
    read as ''; ``ne`` is null-safe; ordered comparisons read a missing value
    as 0; a number compares with cells that read as numbers, whatever the column's
    type; an unknown operator is an error.
    """
    c = _c(field)
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        # per cell, as numbers where the cell reads as one: text columns hold money, too
        number = c.cast("string").try_cast("decimal(38,10)") if not isinstance(value, float) else c.cast("string").try_cast("double")
        other = F.lit(Decimal(value)).cast("decimal(38,10)") if not isinstance(value, float) else F.lit(value)
        if op == "eq":
            return F.coalesce(number == other, F.lit(False))
        if op == "ne":
            return ~F.coalesce(number == other, F.lit(False))
        if op in ("gt", "lt", "gte", "lte"):
            lhs = F.coalesce(number, F.lit(0).cast("decimal(38,10)") if not isinstance(value, float) else F.lit(0.0))
            return {"gt": lhs > other, "lt": lhs < other, "gte": lhs >= other, "lte": lhs <= other}[op]
    if op == "eq":
        if isinstance(value, str):
            return text == value.lower()
        return F.coalesce(c == F.lit(value), F.lit(False))
    if op == "ne":
        return ~c.eqNullSafe(F.lit(value))
    if op in ("gt", "lt", "gte", "lte"):
        lhs = F.coalesce(c, F.lit(0))
        return {"gt": lhs > value, "lt": lhs < value, "gte": lhs >= value, "lte": lhs <= value}[op]
    if op == "contains":
        needle = "" if value is None else str(value).lower()
        return F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains(needle)
    if op == "in":
        members = _as_list(value)
        numbers = [v for v in members if isinstance(v, (int, float)) and not isinstance(v, bool)]
        others = [v for v in members if v not in numbers]
        found = F.coalesce(c.isin(others), F.lit(False)) if others else F.lit(False)
        return functools.reduce(operator.or_, [predicate(field, "eq", v) for v in numbers], found)
    raise ValueError(f"unknown filter operator {op!r}; expected one of {OPERATORS}")


def nested_predicate(field: str, op: str, value: Any, array_col: str = "suborders") -> Column:
    """the predicate holds for at least one element of ``suborders``.

    Numeric comparison is decided per cell: both sides are read as numbers
    when they parse, otherwise ``eq``/``ne`` fall back to lower-case text.
    """
    v = _num(value)

    def cell(s: Column) -> Column:
        x = s[field]
        xn = x.cast("string").try_cast("double")
        text = F.lower(F.coalesce(x.cast("string"), F.lit("")))
        if op in ("eq", "ne"):
            if v is not None:
                same = F.coalesce(xn == F.lit(v), text == str(value).lower())
                return x.isNotNull() & (same if op == "eq" else ~same)
            same = text == str(value).lower()
            return same if op == "eq" else ~same
        if op in ("gt", "lt", "gte", "lte"):
            if v is None:
                raise ValueError(f"{op} needs a numeric value, got {value!r}")
            cmp = {"gt": xn > v, "lt": xn < v, "gte": xn >= v, "lte": xn <= v}[op]
            return x.isNotNull() & F.coalesce(cmp, F.lit(False))
        if op == "contains":
            return text.contains("" if value is None else str(value).lower())
        if op == "in":
            return F.coalesce(x.isin(_as_list(value)), F.lit(False))
        raise ValueError(f"unknown filter operator {op!r}; expected one of {OPERATORS}")

    return F.coalesce(F.exists(F.col(array_col), cell), F.lit(False))


def compile_filters(specs: Iterable[dict], nested_fields: Iterable[str] = ()) -> Column:
    """AND of all specs ``{field, operator='eq', value}``."""
    nested = set(nested_fields)
    conds = []
    for spec in specs:
        field, op, value = spec["field"], spec.get("operator", "eq"), spec.get("value")
        conds.append(nested_predicate(field, op, value) if field in nested else predicate(field, op, value))
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


def apply_filters(df: DataFrame, specs: Iterable[dict], nested_fields: Iterable[str] = ()) -> DataFrame:
    return df.where(compile_filters(list(specs), nested_fields))


def status_in(statuses: Iterable[str], col: str = "order_status") -> Column:
    """status (trimmed) is in the given set."""
    return F.coalesce(F.trim(_c(col)).isin(list(statuses)), F.lit(False))


def status_mentions(word: str, *cols: str) -> Column:
    """any of the status columns contains ``word`` (case-insensitive)."""
    cols = cols or ("order_status", "shipping_status")
    return functools.reduce(operator.or_, [F.coalesce(F.lower(_c(c)).contains(word.lower()), F.lit(False)) for c in cols])


def state_equals(state: str, state_col: str = "state", pin_col: str = "pin_code") -> Column:
    """F8: case-insensitive state match; rows without state or pincode drop."""
    return _c(state_col).isNotNull() & _c(pin_col).isNotNull() & (F.lower(_c(state_col)) == state.lower())


def drop_null_dates(df: DataFrame, col: str = "order_date") -> DataFrame:
    """F10."""
    return df.where(_c(col).isNotNull())
