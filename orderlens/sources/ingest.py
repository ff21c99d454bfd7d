"""Order ingest: projection to the flat history row (C4/C5), keyed upsert (S11), daily run.

The source system pages an API, writes one JSON file per day, projects each
order to a flat row and upserts it in batches of 25 into a key-value table.
Here the same run is one batch job over the date range: land the documents
(S10), read the range back (S1), project with column expressions, and merge
into a bucketed Parquet table where the newest row per ``invoice_id`` wins; a
run reads and rewrites the buckets of its own invoices alone (``buckets``).
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import WRITES, settings
from .buckets import COLUMN, BucketedRun
from .nested import read_daily_orders, write_daily_json

PRIMARY_KEY = "invoice_id"


def _pick(*cols: Column) -> Column:
    """First value that is not null and not the empty string."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


def project_orders(docs: DataFrame, source_tag: str | Column, source_month: str | Column, key: str = PRIMARY_KEY,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """C4: one flat row per order; the order's own value of a field, else the FIRST suborder's. ``extra`` columns are
    carried along.

    ``get(suborders, 0)`` is null for an empty or missing array. A row without
    the primary key fails the job (the source raises for it too).
    """
    tag, month = (c if isinstance(c, Column) else F.lit(c) for c in (source_tag, source_month))
    first = F.get(F.col("suborders"), 0)

    def own(name: str) -> list[Column]:
        """The order's value of a field, if the documents have it; an empty list or object is no value."""
        return [F.when(~F.col(name).cast("string").isin("[]", "{}"), F.col(name))] if name in docs.columns else []

    def pick(name: str, sub: str) -> Column:
        return _pick(*own(name), first[sub])

    def count(name: str) -> Column:
        return _pick(*(c.cast("string").try_cast("decimal(20,4)").try_cast("bigint") for c in own(name)), first[name])

    sku, suborder_sku = pick("sku", "sku"), pick("suborder_sku", "sku")
    sub_mp_sku, mp_sku = pick("suborder_marketplace_sku", "marketplace_sku"), pick("marketplace_sku", "marketplace_sku")
    k = F.col(key).cast("string")
    checked_key = F.when(k.isNull() | (k == ""), F.raise_error(F.lit(f"order is missing required primary key '{key}'"))) \
        .otherwise(k)
    return docs.select(
        checked_key.alias(key), tag.alias("source_file"), month.alias("source_month"), *extra,
        "order_id", "order_date", "total_amount",
        count("item_quantity").alias("item_quantity"),
        pick("suborder_model_no", "model_no").alias("suborder_model_no"),
        count("suborder_quantity").alias("suborder_quantity"),
        "order_quantity", sku.alias("sku"), suborder_sku.alias("suborder_sku"),
        sub_mp_sku.alias("suborder_marketplace_sku"), mp_sku.alias("marketplace_sku"),
        "order_status", "payment_mode", "order_type", "marketplace", "courier", "import_warehouse_name", "state",
        "billing_state",
        pick("size", "size").alias("size"), pick("suborder_size", "size").alias("suborder_size"),
        pick("suborder_selling_price", "selling_price").alias("suborder_selling_price"),
        pick("suborder_cost", "cost").alias("suborder_cost"), pick("suborder_mrp", "mrp").alias("suborder_mrp"),
        pick("suborder_productName", "productName").alias("suborder_productName"),
        _pick(*own("canonical_sku"), sku, suborder_sku, sub_mp_sku, mp_sku).alias("canonical_sku"))


def upsert(stored: DataFrame | None, new: DataFrame, key: str = PRIMARY_KEY, order_col: str = "_load_seq",
           table: BucketedRun | None = None, lying: bool = False) -> DataFrame:
    """The last write per key wins: a later batch over the stored rows, then the greatest ``order_col`` (the load
    position: a day, file, place in it), then, among rows without one, the row itself.

    One aggregation over the union — no join and no per-key collection; a hot
    key is reduced map-side to one candidate per task before the shuffle. With
    the ``table`` that the rows are for, they are dealt by its buckets, once,
    and aggregated and written there; stored rows that are ``lying`` so (its
    ``read_dealt``) aren't moved.
    """
    cols = [c for c in new.columns if c not in (key, order_col)]
    position = new.schema[order_col].dataType if order_col in new.columns else None

    def tag(df: DataFrame, prio: int) -> DataFrame:
        seq = (F.lit(0) if position is None else
               F.col(order_col) if order_col in df.columns else F.lit(None).cast(position))
        return df.select(key, F.struct(F.lit(prio).alias("_p"), seq.alias("_s"), F.struct(*cols).alias("_row")).alias("_v"))
    by = [key] if table is None else [key, COLUMN]
    if stored is not None and table is not None and table.pieces and lying:
        parts = table.lying(tag(stored, 0), key).unionByName(table.dealt(tag(new, 1), key))
    else:
        parts = tag(new, 1) if stored is None else tag(stored, 0).unionByName(tag(new, 1))
        parts = parts if table is None else table.dealt(parts, key)
    return parts.groupBy(*by).agg(F.max("_v").alias("_v")).select(*by, "_v._row.*")


def with_load_position(landed: DataFrame) -> DataFrame:
    """Where a landed document stands: its day, file, block and place in the block, later ones greater."""
    return landed.withColumn("_load_seq", F.struct(
        F.col("day").alias("day"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def run_extraction(spark: SparkSession, docs: DataFrame, landing: str, table_root: str,
                   start_day: str, end_day: str, source_tag: str = "orders", n_buckets: int | None = None,
                   dealt: bool = False) -> DataFrame:
    """Land the day range, project, upsert into the history table; per-day counters. ``dealt``: see ``write_daily_json``.

    Every row carries the month and file name (``<source_tag>_<day>``) of its own day. Returns
    ``(day, orders_landed, rows_upserted)``; the buckets of the run's invoices are merged and committed
    as a new version, unique to the run, under ``table_root``.
    """
    ts = F.col("order_date").cast("string").try_cast("timestamp_ntz")
    in_range = docs.where((F.to_date(ts) >= F.lit(start_day)) & (F.to_date(ts) <= F.lit(end_day)))
    with settings(spark, WRITES):
        write_daily_json(in_range, landing, dealt)
    landed = with_load_position(read_daily_orders(spark, landing, start_day, end_day))
    day = F.col("day")
    projected = project_orders(landed, F.concat_ws("_", F.lit(source_tag), day), F.substring(day, 1, 7),
                               extra=("day", "_load_seq"))
    run = f"{start_day}_{end_day}-{uuid.uuid4().hex[:8]}"
    table = BucketedRun(spark, table_root, run, n_buckets)
    with settings(spark, WRITES):
        table.merge("history", projected, PRIMARY_KEY, partial(upsert, table=table, lying=True))
    table.commit()
    counts = landed.groupBy("day").agg(F.count(F.lit(1)).alias("orders_landed"))
    return counts.join(projected.groupBy("day").agg(F.countDistinct(PRIMARY_KEY).alias("rows_upserted")), "day", "left")
