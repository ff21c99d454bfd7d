"""Small read paths: side-sheet scans (S5, S6), filter options (S7), preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HISTORY_COLUMNS

FILTER_OPTION_COLUMNS = {"warehouse_names": "import_warehouse_name", "marketplace_names": "marketplace",
                         "courier_names": "courier", "billing_state_names": "billing_state"}


def vendor_costs(sheet: DataFrame) -> DataFrame:
    """The full vendor cost sheet."""
    return sheet


def payment_cycle_for(sheet: DataFrame, party_name: str | None = None) -> DataFrame:
    """Payment-cycle rows, optionally for one party (equality, pushed to the scan)."""
    return sheet if party_name is None else sheet.where(F.col("party_name") == party_name)


def filter_options(history: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank names per filter dimension (long form, by option and name); one scan."""
    pairs = F.array(*(F.struct(F.lit(name).alias("option"), F.trim(F.col(col)).alias("value"))
                      for name, col in FILTER_OPTION_COLUMNS.items()))
    return (history.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct().orderBy("option", "value"))


def preview(fetched: DataFrame, n: int = 3, order: tuple[str, ...] = ("order_date", "order_id", "sku")) -> DataFrame:
    """The first n rows (fixed column list, deterministic order) and the total row count."""
    total = fetched.agg(F.count(F.lit(1))).scalar()
    cols = [c for c in HISTORY_COLUMNS if c in fetched.columns]
    return fetched.orderBy(*order).limit(n).select(*cols).withColumn("total_rows_fetched", total)
