"""Nested order documents: build, land as daily JSON, read back, normalise, salvage.

* ``posted_orders``   — nested order documents derived from the driver tables
  (one document per order, ``suborders[]`` = its lines; FIXTURES.md §2.3).
* ``write_daily_json`` (S10) — one folder per day under a month folder, with
  dynamic partition overwrite so re-landing a day replaces only that day.
* ``read_daily_orders`` (S1) — declared-schema JSON scan of a day range;
  missing days are simply absent; the day/month partition columns prune.
* ``normalize_payload`` (S2) — list root, ``{data:{orders}}``, ``{orders}`` or a
  single object → one row per order.
* ``read_order_days`` — S1 in the source layout: missing days are absent,
  damaged files go through S3, files without a readable order are reported.
* ``salvage_files`` (S3) — byte-level reading of damaged files: UTF-8, else
  Latin-1; every whole order with its suborders is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import order_document_schema
from .history import load_history
from .tables import FIRST_DATE

ORDER_FIELDS = [f.name for f in order_document_schema().fields if f.name != "suborders"]


def posted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order documents (text-typed money and dates, as the order API sends them).

    Order-level attributes that live on lines in the driver tables (status,
    courier, warehouse) come from the order's first line (lowest line number,
    then status), matching the first-suborder rule of the ingest projection.
    """
    return _documents(load_history(spark, sf_dir), "order_id")


def posted_orders_by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """``posted_orders`` for a landing by day, and whether they lie that way: lines are dealt by the date of their
    document before it is built, as they are a fraction of its text, and a window of days leaves out the others' lines."""
    lines = load_history(spark, sf_dir, orders_first=True, by_date=True)
    if FIRST_DATE not in lines.columns:   # a written history: documents are built where its lines come together
        return posted_orders(spark, sf_dir), False
    return _documents(lines, FIRST_DATE, "order_id"), True


def _documents(lines: DataFrame, *by: str) -> DataFrame:
    """The documents of lines grouped by ``by``: the order's id, and with it the date that its id tells."""
    # where the date is a group's own column, a filter by day reaches the lines
    order_date = F.col(FIRST_DATE if FIRST_DATE in by else "order_date")
    cancelled = F.col("order_status") == "Cancelled"
    returned = F.col("order_status").isin("Returned", "RTO")
    shipped = F.col("order_status").isin("Shipped", "Manifest Scanned")
    q = F.col("item_quantity")
    ts_fmt = "yyyy-MM-dd HH:mm:ss"
    sub = F.struct(
        F.col("line_no").alias("_line"),
        F.col("sku"), F.col("raw_sku").alias("marketplace_sku"), F.col("model_no"),
        F.col("product_name").alias("productName"), F.col("brand"), F.lit(None).cast("string").alias("category"),
        F.regexp_extract("sku", "_([^_]*)$", 1).alias("size"),
        F.col("mrp").cast("string").alias("selling_price"), F.col("cost").cast("string").alias("cost"),
        F.col("mrp").cast("string").alias("mrp"),
        q.alias("item_quantity"), q.alias("suborder_quantity"),
        F.when(cancelled, q).otherwise(0).cast("bigint").alias("cancelled_quantity"),
        F.when(shipped, q).otherwise(0).cast("bigint").alias("shipped_quantity"),
        F.when(returned, q).otherwise(0).cast("bigint").alias("returned_quantity"),
        F.struct(
            F.date_format(F.timestamp_add("HOUR", F.col("line_no"), F.col("order_date")), ts_fmt)
            .alias("inventory_assigned_datetime"),
            F.date_format(F.timestamp_add("HOUR", F.col("line_no") * 2, F.col("order_date")), ts_fmt)
            .alias("qc_pass_datetime"),
            F.lit(None).cast("string").alias("confirm_datetime"),
            F.lit(None).cast("string").alias("manifest_datetime")).alias("suborder_history"),
        F.array(F.struct(F.when(cancelled, q).otherwise(0).cast("bigint").alias("cancelled_quantity"),
                         F.when(returned, q).otherwise(0).cast("bigint").alias("returned_quantity"))).alias("items"),
        F.col("order_status").alias("_status"), F.col("courier").alias("_courier"),
        F.col("import_warehouse_name").alias("_wh"))
    docs = lines.groupBy(*by).agg(
        F.min("order_date").alias("order_date"),
        F.sum("total_amount").alias("total_amount"),
        F.sum("item_quantity").alias("order_quantity"),
        F.min("payment_mode").alias("payment_mode"),
        F.min("order_type").alias("order_type"),
        F.min("state").alias("state"),
        F.min("marketplace").alias("marketplace"),
        F.min("pin_code").alias("pin_code"),
        F.min(F.struct(F.col("line_no"), F.col("order_status"), F.col("courier"), F.col("import_warehouse_name")))
        .alias("_first"),
        F.sort_array(F.collect_list(sub)).alias("_subs"))
    sub_fields = [f.name for f in order_document_schema()["suborders"].dataType.elementType.fields]
    return docs.select(
        F.col("order_id").cast("string").alias("invoice_id"), F.col("order_id").cast("string").alias("order_id"),
        F.date_format(order_date, ts_fmt).alias("order_date"), F.date_format(order_date, ts_fmt).alias("invoice_date"),
        F.col("total_amount").cast("string").alias("total_amount"),
        F.lit("0.0000").alias("total_tax"), F.lit("0.0000").alias("total_shipping_charge"),
        F.lit("0.0000").alias("total_discount"),
        F.col("order_quantity").cast("bigint").alias("order_quantity"),
        F.col("_first.order_status").alias("order_status"), F.lit(None).cast("string").alias("shipping_status"),
        "payment_mode", "order_type", "marketplace", F.col("_first.courier").alias("courier"),
        F.col("_first.import_warehouse_name").alias("import_warehouse_name"), "state",
        F.lit(None).cast("string").alias("city"), "pin_code", F.col("state").alias("billing_state"),
        F.transform("_subs", lambda s: F.struct(*[s[n].alias(n) for n in sub_fields])).alias("suborders"))


def write_daily_json(docs: DataFrame, path: str, dealt: bool = False) -> None:
    """Land documents as JSON, one folder per day under its month folder.

    The text is made before the shuffle, where it compresses better than nested rows, and is written compressed, as
    field names and repeated values make up most of it. A file is a task's share of a day and is read whole. Documents
    that are ``dealt`` by day already are written where they lie.
    """
    ts = F.col("order_date").cast("string").try_cast("timestamp_ntz")
    texts = docs.select(F.date_format(ts, "yyyy-MM").alias("month"), F.date_format(ts, "yyyy-MM-dd").alias("day"), "order_id",
                        F.to_json(F.struct(*docs.columns)).alias("value"))
    # range-partitioned on (day, order_id): a hot day is split over several tasks and
    # each task covers a contiguous day range, so few files per day folder
    texts = texts if dealt else texts.repartitionByRange("day", "order_id")
    (texts.select("month", "day", "value")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
     .partitionBy("month", "day").text(path))


def read_daily_orders(spark: SparkSession, path: str, start_day: str | None = None,
                      end_day: str | None = None) -> DataFrame:
    """Read landed day folders in [start_day, end_day] with the declared schema."""
    schema = order_document_schema().add("month", T.StringType()).add("day", T.StringType())
    df = spark.read.schema(schema).json(path)
    if start_day:
        df = df.where(F.col("day") >= start_day)
    if end_day:
        df = df.where(F.col("day") <= end_day)
    return df


def day_paths(root: str, start_day: str, end_day: str) -> list[str]:
    """Day file paths ``root/YYYY-MM/YYYY-MM-DD.json`` for a range (driver-side list of days)."""
    d0, d1 = date.fromisoformat(start_day), date.fromisoformat(end_day)
    out = []
    while d0 <= d1:
        out.append(f"{root.rstrip('/')}/{d0:%Y-%m}/{d0.isoformat()}.json")
        d0 += timedelta(days=1)
    return out


def payload_schema() -> T.StructType:
    """Union of the accepted payload shapes (list root / single object / {orders} / {data:{orders}})."""
    doc = order_document_schema()
    fields = list(doc.fields)
    fields.append(T.StructField("orders", T.ArrayType(doc)))
    fields.append(T.StructField("data", T.StructType([T.StructField("orders", T.ArrayType(doc))])))
    return T.StructType(fields)


def normalize_payload(raw: DataFrame) -> DataFrame:
    """One row per order whatever the payload shape."""
    own = F.struct(*[F.col(c) for c in [f.name for f in order_document_schema().fields]])
    has_own = F.col("order_id").isNotNull() | F.col("invoice_id").isNotNull()
    docs = F.coalesce(F.col("data.orders"), F.col("orders"), F.when(has_own, F.array(own)))
    return raw.select(F.explode(docs).alias("o")).select("o.*")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that holds it; lacking rights or a broken link is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_order_days(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """S1 + S2 + S3 for day files in the source layout: (orders, quarantine).

    A path that isn't there is a day without orders. Whole files are parsed by
    Spark; files that don't parse go through the salvage, which keeps every
    whole order in them; files that yield nothing are reported in
    ``quarantine`` (path, reason).
    """
    existing = [p for p in paths if _exists(spark, p)]
    none = (spark.createDataFrame([], order_document_schema()), spark.createDataFrame([], "path string, reason string"))
    if not existing:
        return none
    schema = payload_schema().add("_corrupt", T.StringType())
    raw = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").json(existing)
           .withColumn("_path", F.col("_metadata.file_path")))
    damaged = sorted(r["_path"] for r in raw.where(F.col("_corrupt").isNotNull() & F.col("order_id").isNull())
                     .select("_path").distinct().collect())   # at most one row per day file
    orders = normalize_payload(raw.where(~F.col("_path").isin(damaged)) if damaged else raw)
    if not damaged:
        return orders, none[1]
    salvaged, quarantine = salvage_files(spark, damaged)
    return orders.unionByName(salvaged.drop("path")), quarantine


def read_order_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The orders of ``read_order_days``."""
    return read_order_days(spark, paths)[0]


def whole_orders(content: bytes) -> list[str]:
    """The whole orders in a damaged file as JSON texts, each with its suborders: from every opening brace on, the
    object that begins there, if it is whole; objects that hold orders are taken apart."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    decode, found, at = json.JSONDecoder().raw_decode, [], text.find("{")
    while at >= 0:
        try:
            thing, end = decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1   # cut off or damaged: look inside it
        else:
            inside = thing.get("data") if isinstance(thing.get("data"), dict) else thing
            several = inside.get("orders")
            found += [o for o in (several if isinstance(several, list) else [thing])
                      if isinstance(o, dict) and (o.get("order_id") is not None or o.get("invoice_id") is not None)]
        at = text.find("{", end)
    return [json.dumps(o) for o in found]


def salvage_files(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """S3: read damaged JSON files byte-wise; return (orders, quarantine).

    UTF-8 when valid, else Latin-1; every whole order is kept with its
    ``suborders[]``, whatever the payload's shape and wherever the damage is.
    Files yielding nothing go to the quarantine frame ``(path, reason)``. A
    file is one row here, so it must be smaller than 2 GiB.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def taken(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "found": [whole_orders(c) for c in part["content"]]})

    found = files.mapInPandas(taken, "path string, found array<string>")
    orders = (found.select("path", F.explode("found").alias("j"))
              .select("path", F.from_json("j", order_document_schema()).alias("o")).select("path", "o.*"))
    quarantine = found.where(F.size("found") == 0).select("path", F.lit("no readable order").alias("reason"))
    return orders, quarantine
