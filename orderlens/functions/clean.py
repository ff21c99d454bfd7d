"""Cleaning and derived columns (all JVM-side Column expressions).

Each helper returns a ``Column``; ``enrich`` applies the whole set in one
``withColumns`` so Catalyst fuses it into the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MONEY, ORDER_STATUS_VALUES, ORDER_TYPE_VALUES, PAYMENT_MODE_VALUES, SKU_PREFIX, UNKNOWN


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """C5 building block: trimmed text, or null when empty."""
    return F.nullif(F.trim(_c(c).cast("string")), F.lit(""))


def first_non_empty(*cols: str | Column) -> Column:
    """First value that is neither null nor blank (trimmed)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def to_timestamp_lenient(c: str | Column) -> Column:
    """Text or timestamp → zone-free timestamp (wall clock kept exactly); unparsable → null."""
    return _c(c).cast("string").try_cast("timestamp_ntz")


def to_number(c: str | Column, dtype: T.DataType = MONEY) -> Column:
    """Lenient numeric coercion; bad or null → 0."""
    return F.coalesce(_c(c).cast("string").try_cast(dtype), F.lit(0).cast(dtype))


def label_or_unknown(c: str | Column, upper: bool = False) -> Column:
    """Trimmed (optionally upper-cased) label; null or blank → UNKNOWN."""
    v = F.trim(_c(c))
    if upper:
        v = F.upper(v)
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(UNKNOWN))


def _enum_normalize(c: str | Column, members: list[str]) -> Column:
    """Case-insensitive match to a member; unknown values pass through trimmed."""
    key = F.upper(F.trim(_c(c)))
    lookup = F.create_map(*[x for m in members for x in (F.lit(m.upper()), F.lit(m))])
    return F.coalesce(F.try_element_at(lookup, key), F.trim(_c(c)))


def normalize_status(c: str | Column = "order_status") -> Column:
    """C11: order status to its member spelling; null or blank → UNKNOWN."""
    return F.when(blank_to_null(c).isNull(), F.lit(UNKNOWN)).otherwise(_enum_normalize(c, ORDER_STATUS_VALUES))


def normalize_payment_member(c: str | Column = "payment_mode") -> Column:
    """C11: payment mode to its member spelling (COD / PrePaid); blank → null."""
    return F.when(blank_to_null(c).isNotNull(), _enum_normalize(c, PAYMENT_MODE_VALUES))


def normalize_order_type(c: str | Column = "order_type") -> Column:
    """C11: order type to its member spelling; blank → null."""
    return F.when(blank_to_null(c).isNotNull(), _enum_normalize(c, ORDER_TYPE_VALUES))


def canonical_sku(*cols: str | Column) -> Column:
    """First non-blank SKU column, leading prefix stripped, else UNKNOWN."""
    cols = cols or ("canonical_sku", "suborder_sku", "sku", "suborder_marketplace_sku", "marketplace_sku")
    first = first_non_empty(*cols)
    return F.coalesce(F.regexp_replace(first, "^" + SKU_PREFIX, ""), F.lit(UNKNOWN))


def size_bucket(sku_col: str | Column = "canonical_sku_normalized",
                size_cols: tuple = ("suborder_size", "size")) -> Column:
    """C14: explicit size, else text after the last '_' of the SKU, else UNKNOWN."""
    from_sku = blank_to_null(F.regexp_extract(_c(sku_col), "_([^_]*)$", 1))
    return F.coalesce(first_non_empty(*size_cols), from_sku, F.lit(UNKNOWN))


def base_sku(sku_col: str | Column = "canonical_sku_normalized") -> Column:
    """SKU text before its last '_' (whole SKU when there is none)."""
    return F.regexp_replace(_c(sku_col), "_[^_]*$", "")


def strip_sku_prefix(c: str | Column) -> Column:
    """Trimmed SKU without the leading prefix."""
    return F.regexp_replace(F.trim(_c(c)), "^" + SKU_PREFIX, "")


def parse_raw_sku(c: str | Column) -> tuple[Column, Column]:
    """Split a hyphenated SKU; drop leading digit-free segments; last part is the size.

    Returns ``(base, size)``. With fewer than two remaining segments the base is
    the raw value unchanged and the size is the empty string.
    """
    raw = _c(c)
    parts = F.split(F.trim(raw), "-")
    first = F.array_position(F.transform(parts, lambda x: x.rlike("[0-9]")), F.lit(True))
    kept = F.when(first > 0, F.slice(parts, first.cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))
    n = F.size(kept)
    size = F.when(n >= 2, F.element_at(kept, -1)).otherwise(F.lit(""))
    base = F.when(n >= 2, F.array_join(F.slice(kept, 1, n - 1), "-")).otherwise(raw)
    return base, size


def calendar_columns(ts: str | Column = "order_date") -> dict[str, Column]:
    """Date, weekday index (Mon=0), 3-letter day, hour, week start, month start."""
    t = _c(ts)
    return {
        "order_date_only": F.to_date(t),
        "day_of_week": F.weekday(t),
        "day_label": F.date_format(t, "EEE"),
        "hour_of_day": F.hour(t),
        "week_start": F.to_date(F.date_trunc("week", t)),
        "month_start": F.to_date(F.date_trunc("month", t)),
    }


def enrich(df: DataFrame) -> DataFrame:
    """C17: the full enrichment step in one projection."""
    cols = {
        "payment_mode": label_or_unknown("payment_mode", upper=True),
        "order_status": normalize_status("order_status"),
        "state": label_or_unknown("state"),
        "canonical_sku_normalized": canonical_sku(),
    }
    df = df.withColumns(cols)
    df = df.withColumns({
        "size_bucket": size_bucket(),
        "base_sku": base_sku(),
        **calendar_columns("order_date"),
    })
    return df


def safe_pct(n: Column, d: Column) -> Column:
    """N / d * 100 as double; 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")) * F.lit(100.0), F.lit(0.0))


def growth_pct(cur: Column, prev: Column) -> Column:
    """(cur - prev) / prev * 100; 0/0 → 0; x/0 → 100."""
    cur, prev = cur.cast("double"), prev.cast("double")
    return (F.when(F.coalesce(prev, F.lit(0.0)) == 0, F.when(F.coalesce(cur, F.lit(0.0)) == 0, 0.0).otherwise(100.0))
            .otherwise((cur - prev) / prev * F.lit(100.0)))


def money(c: Column, scale: int = 2) -> Column:
    """Exact decimal rounded half-up, then double (hash-stable across engines)."""
    return F.round(c, scale).cast("double")


def ratio(n: Column, d: Column, scale: int = 2) -> Column:
    """Double ratio rounded; 0 when the denominator is 0."""
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0)), scale)


def bucket_label(bucket: Column, grain: str | Column) -> Column:
    """Chart label for a bucket start date."""
    if isinstance(grain, Column):
        return (F.when(grain == "daily", bucket_label(bucket, "daily")).when(grain == "weekly", bucket_label(bucket, "weekly"))
                .otherwise(bucket_label(bucket, "monthly")))
    if grain == "daily":
        return F.date_format(bucket, "yyyy-MM-dd")
    if grain == "weekly":
        return F.concat(F.date_format(bucket, "MMM dd"), F.lit(" - "), F.date_format(F.date_add(bucket, 6), "MMM dd"))
    if grain == "monthly":
        return F.date_format(bucket, "MMM yyyy")
    raise ValueError(f"unknown grain {grain!r}")
