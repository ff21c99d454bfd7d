"""Nested JSON sources (S1–S3, S10), ingest projection (C4) and upsert (S11) on hand-made files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from orderlens.operators.posted import flatten_orders
from orderlens.sources import ingest, nested

ORDER = {"invoice_id": "9", "order_id": "1", "order_date": "2026-02-17 08:53:40", "total_amount": "601.0001",
         "payment_mode": "COD", "state": "Telangana",
         "suborders": [{"sku": "11200-850-9", "item_quantity": 1, "selling_price": "601", "size": "9"},
                       {"sku": "X-2", "item_quantity": 2}]}


def _write(path, content: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(content)


def test_payload_shapes(spark, tmp_dir):
    o2 = dict(ORDER, invoice_id="10", order_id="2")
    files = {
        "2026-02/2026-02-17.json": json.dumps([ORDER, o2]),
        "2026-02/2026-02-18.json": json.dumps({"data": {"orders": [dict(ORDER, invoice_id="11")]}}),
        "2026-02/2026-02-19.json": json.dumps({"orders": [dict(ORDER, invoice_id="12")]}),
        "2026-02/2026-02-20.json": json.dumps(dict(ORDER, invoice_id="13")),
    }
    for rel, text in files.items():
        _write(os.path.join(tmp_dir, rel), text.encode())
    paths = nested.day_paths(tmp_dir, "2026-02-16", "2026-02-21")      # 16th and 21st are missing days
    got = nested.read_order_files(spark, paths)
    assert sorted(r.invoice_id for r in got.collect()) == ["10", "11", "12", "13", "9"]
    assert got.where(F.size("suborders") == 2).count() == 5


def test_salvage_truncated_and_latin1(spark, tmp_dir):
    flat = {"invoice_id": "21", "order_id": "21", "order_status": "Cancelled"}
    truncated = "[" + json.dumps(flat) + ", " + json.dumps(dict(flat, invoice_id="22")) + ', {"invoice_id": "23", "ord'
    _write(os.path.join(tmp_dir, "a.json"), truncated.encode())
    _write(os.path.join(tmp_dir, "b.json"), json.dumps([dict(flat, invoice_id="31", state="Bihár")]).encode("latin-1"))
    _write(os.path.join(tmp_dir, "c.json"), b"\x00\x01 not json at all")
    orders, quarantine = nested.salvage_files(spark, [os.path.join(tmp_dir, f) for f in ("a.json", "b.json", "c.json")])
    got = {r.invoice_id: r for r in orders.collect()}
    assert sorted(got) == ["21", "22", "31"]
    assert got["31"].state == "Bihár"
    assert [os.path.basename(r.path) for r in quarantine.collect()] == ["c.json"]


def test_daily_landing_roundtrip_and_day_pruning(spark, tmp_dir):
    docs = spark.read.schema(nested.order_document_schema()).json(
        spark.sparkContext.parallelize([json.dumps(dict(ORDER, invoice_id=str(i), order_date=f"2026-02-1{i} 10:00:00"))
                                        for i in range(1, 6)]))
    nested.write_daily_json(docs, tmp_dir + "/land")
    back = nested.read_daily_orders(spark, tmp_dir + "/land", "2026-02-12", "2026-02-14")
    assert sorted(r.invoice_id for r in back.collect()) == ["2", "3", "4"]
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()


def test_projection_and_upsert(spark):
    docs = spark.read.schema(nested.order_document_schema()).json(
        spark.sparkContext.parallelize([json.dumps(ORDER), json.dumps(dict(ORDER, invoice_id="8", suborders=[]))]))
    p = {r.invoice_id: r for r in ingest.project_orders(docs, "f", "2026-02").collect()}
    assert (p["9"].sku, p["9"].item_quantity, p["9"].suborder_selling_price, p["9"].size) == ("11200-850-9", 1, "601", "9")
    assert p["8"].sku is None and p["8"].canonical_sku is None
    old = ingest.project_orders(docs, "f", "2026-02")
    new = ingest.project_orders(docs.where("invoice_id = '9'").withColumn("state", F.lit("Goa")), "g", "2026-03")
    merged = {r.invoice_id: r for r in ingest.upsert(old, new).collect()}
    assert len(merged) == 2 and merged["9"].state == "Goa" and merged["8"].state == "Telangana"
    bad = docs.withColumn("invoice_id", F.lit(None).cast("string"))
    with pytest.raises(Exception):
        ingest.project_orders(bad, "f", "x").collect()


LEVELS = {"sku": "O-1-7", "suborder_sku": "O-2-7", "suborder_marketplace_sku": "OM-1", "marketplace_sku": "OM-2", "size": "7",
          "suborder_size": "8", "suborder_model_no": "M", "suborder_selling_price": "5", "suborder_cost": "3",
          "suborder_mrp": "9", "suborder_productName": "N", "canonical_sku": "O-1"}


def test_order_level_fields_come_before_the_first_suborders(spark, tmp_dir):
    orders = [dict(ORDER, **LEVELS, item_quantity=4, suborder_quantity="5", invoice_id="1", suborders=[]),
              dict(ORDER, **LEVELS, item_quantity=4, suborder_quantity=5, invoice_id="2"),
              dict(ORDER, **LEVELS, item_quantity=4, suborder_quantity=5, invoice_id="3", suborders=None),
              dict(ORDER, invoice_id="4", sku="", size=[], item_quantity="", canonical_sku=None, marketplace_sku={}),
              dict(ORDER, invoice_id="5", sku="O-1-7", suborders=[])]
    _write(f"{tmp_dir}/2026-02-17.json", json.dumps({"data": {"orders": orders}}).encode())
    docs = nested.read_order_files(spark, [f"{tmp_dir}/2026-02-17.json"])
    got = {r.invoice_id: r.asDict() for r in ingest.project_orders(docs, "f", "2026-02").collect()}
    for i in "123":
        assert {k: got[i][k] for k in LEVELS} == LEVELS and (got[i]["item_quantity"], got[i]["suborder_quantity"]) == (4, 5)
    assert [got["4"][k] for k in ("sku", "size", "item_quantity", "canonical_sku", "marketplace_sku")] == [
        "11200-850-9", "9", 1, "11200-850-9", None]
    assert got["5"]["canonical_sku"] == "O-1-7"
    # the same through landing and reading back, and no name twice in the flat rows
    nested.write_daily_json(docs, tmp_dir + "/land")
    back = {r.invoice_id: r.asDict() for r in ingest.project_orders(
        nested.read_daily_orders(spark, tmp_dir + "/land"), "f", "2026-02").collect()}
    assert back == got
    flat = flatten_orders(docs)
    assert len(set(flat.columns)) == len(flat.columns)
    assert {(r.invoice_id, r.suborder_sku) for r in flat.collect()} == {
        ("1", "O-2-7"), ("2", "11200-850-9"), ("2", "X-2"), ("3", "O-2-7"), ("4", "11200-850-9"), ("4", "X-2"), ("5", None)}


def test_upsert_keeps_the_last_write(spark):
    rows = spark.createDataFrame([("1", "Shipped", 1), ("1", "Cancelled", 2), ("2", "Zed", 5), ("2", "Alpha", 9)],
                                 "invoice_id string, order_status string, _load_seq long")
    got = {r.invoice_id: r.order_status for r in ingest.upsert(None, rows).collect()}
    assert got == {"1": "Cancelled", "2": "Alpha"}
    later = spark.createDataFrame([("2", "Aaa", 0)], rows.schema)
    assert {r.order_status for r in ingest.upsert(rows.drop("_load_seq"), later).collect()} >= {"Aaa"}


def test_extraction_stamps_each_day(spark, tmp_dir):
    docs = spark.read.schema(nested.order_document_schema()).json(
        spark.sparkContext.parallelize([json.dumps(dict(ORDER, invoice_id=str(i), order_date=f"2026-0{i}-11 10:00:00"))
                                        for i in range(1, 4)]))
    for _ in range(2):   # a rerun of the same range is a new version
        ingest.run_extraction(spark, docs, tmp_dir + "/land", tmp_dir + "/table", "2026-01-01", "2026-12-31").collect()
    from orderlens.sources import state
    got = {(r.invoice_id, r.source_month, r.source_file) for r in state.read_table(spark, tmp_dir + "/table", "history").collect()}
    assert got == {(str(i), f"2026-0{i}", f"orders_2026-0{i}-11") for i in range(1, 4)}


def test_damaged_days_are_salvaged_and_reported(spark, tmp_dir):
    orders = [dict(ORDER, invoice_id=str(i)) for i in range(1, 4)]
    whole = json.dumps(orders)
    wrapped = json.dumps({"data": {"orders": orders}})
    files = {"2026-02/2026-02-17.json": whole.encode(),
             "2026-02/2026-02-18.json": whole[:len(whole) - 40].encode(),          # cut inside the last order
             "2026-02/2026-02-19.json": wrapped[:len(wrapped) * 2 // 3 + 20].encode(),
             "2026-02/2026-02-20.json": b"[{\"order_id\": "}
    for rel, content in files.items():
        _write(os.path.join(tmp_dir, rel), content)
    got, quarantine = nested.read_order_days(spark, nested.day_paths(tmp_dir, "2026-02-16", "2026-02-21"))
    rows = got.collect()
    assert sorted(r.invoice_id for r in rows) == ["1", "1", "1", "2", "2", "2", "3"]
    assert all(len(r.suborders) == 2 and r.suborders[0].sku == "11200-850-9" for r in rows)
    assert [os.path.basename(r.path) for r in quarantine.collect()] == ["2026-02-20.json"]
