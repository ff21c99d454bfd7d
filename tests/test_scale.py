"""Shuffles, files and task sizes of the steps that many queries share, on rows made here."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from orderlens.operators import bundle, posted
from orderlens.operators import sku_profiles as U
from orderlens.plans import profile_documents as D
from orderlens.plans.profile_job import run_profile_job, window_rows
from orderlens.sources.buckets import COLUMN, BucketedRun
from orderlens.sources import ingest
from orderlens.sources import tables as T
from orderlens.sources.history import history_lines
from orderlens.sources.nested import posted_orders, posted_orders_by_day, read_daily_orders, write_daily_json
from orderlens.sources.tables import order_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, path):
    """Two orders of one customer, three lines of two parts and suppliers."""
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(1, "N1", 0), (2, "N2", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(5, 1, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "supplier": ([(7, 2), (8, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(3, "p3", "b", "t", 4, 10.0), (4, "p4", "b", "t", 5, 20.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 5, "1996-01-02", "1-URGENT"), (2, 5, "1996-01-03", None)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(1, 3, 7, 1, 2.0, 20.0, 0.1, "N", "O", "1996-01-05"), (1, 4, 8, 2, 1.0, 20.0, 0.0, "R", "F", "1996-01-05"),
                      (2, 3, 8, 1, 5.0, 50.0, 0.0, "A", "F", "1996-01-06")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string")}
    for name, (values, schema) in rows.items():
        df = spark.createDataFrame(values, schema)
        for c in ("o_orderdate", "l_shipdate"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture()
def sf(spark, tmp_dir):
    return tables(spark, tmp_dir + "/sf")


def test_lines_are_dealt_by_order_last(spark, sf, monkeypatch):
    """With large parts and orders, and small nations, grouping the joined lines by order adds no shuffle."""
    read = T.read_table
    monkeypatch.setattr(T, "read_table", lambda s, d, name: F.broadcast(read(s, d, name)) if name in (
        "nation", "region") else read(s, d, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        lines = order_lines(spark, sf)
        orders = plan(lines.groupBy("order_id").agg(F.sum("total_amount"), F.max("state"), F.max("courier")))
        assert "SortMergeJoin" in orders and "hashpartitioning(order_id" not in orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {(r.order_id, r.line_no): (r.state, r.courier, r.sku) for r in lines.collect()}
    assert got == {(1, 1): ("N1", "N2", "3_4"), (1, 2): ("N1", "N1", "YCE_4_5"), (2, 1): ("N1", "N1", "3_4")}


def test_landed_files_are_compressed(spark, sf, tmp_dir):
    from orderlens.sources.nested import posted_orders
    docs = posted_orders(spark, sf)
    write_daily_json(docs, tmp_dir + "/landing")
    files = glob.glob(tmp_dir + "/landing/month=*/day=*/part-*")
    assert len(files) == 2 and all(f.endswith(".gz") for f in files)
    cols = [*(c for c in docs.columns if c != "suborders"), "suborders.sku", "suborders.mrp", "suborders.suborder_history"]
    back = read_daily_orders(spark, tmp_dir + "/landing").select(*cols)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select(*cols).collect()))


def test_top_products_reads_the_documents_once(spark, sf):
    from orderlens.sources.nested import posted_orders
    top = posted.top_products(posted_orders(spark, sf))
    assert plan(top).count("collect_list") <= 2   # the steps of one aggregate
    assert {(r.list, r.key, r.value) for r in top.collect()} == {
        ("top_skus_by_quantity", "3_4", 7.0), ("top_skus_by_quantity", "YCE_4_5", 1.0), ("top_skus_by_revenue", "3_4", 70.0),
        ("top_skus_by_revenue", "YCE_4_5", 20.0), ("top_products_by_quantity", "t", 8.0)}


def test_upsert_by_bucket_shuffles_once(spark, tmp_dir):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "invoice_id string, _load_seq int, v string").drop("_load_seq")
    new = spark.createDataFrame([("a", 1, "y"), ("a", 2, "z"), (None, 1, "n")], "invoice_id string, _load_seq int, v string")
    table = BucketedRun(spark, tmp_dir + "/t", "r1", 4)
    merged = ingest.upsert(old, new, table=table)
    assert plan(merged).count("Exchange") == 1
    assert sorted(map(str, merged.drop(COLUMN).collect())) == sorted(map(str, ingest.upsert(old, new).collect()))
    table.merge("t", new, "invoice_id", lambda _, n: ingest.upsert(None, n, table=table))
    table.commit()
    stored = BucketedRun(spark, tmp_dir + "/t").read("t")
    assert {(r.invoice_id, r.v) for r in stored.collect()} == {("a", "z"), (None, "n")} and stored.columns == ["invoice_id", "v"]


def test_sections_group_the_window_where_it_lies(spark, sf, tmp_dir):
    lines = history_lines(order_lines(spark, sf))
    with window_rows(U.prepare(lines), tmp_dir + "/window") as rows:
        for name, table in D.section_tables(rows).items():
            assert "Exchange" not in plan(table), name
        assert rows.count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("orderlens_window")]


def test_profile_json_is_compressed(spark, sf, tmp_dir):
    D.write_profiles(history_lines(order_lines(spark, sf)), tmp_dir + "/root", "1999-01-01", buckets=4)
    docs = D.read_profiles(spark, tmp_dir + "/root")
    D.write_json(docs, tmp_dir + "/json")
    files = glob.glob(tmp_dir + "/json/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert D.read_json(spark, tmp_dir + "/json", docs.schema).where("canonical_sku IS NOT NULL AND _unreadable IS NULL").count() == docs.count() == 3


def test_per_sku_queries_aggregate_dealt_rows(spark, sf):
    """Distinct orders are found after the deal by SKU and order, without another shuffle of rows."""
    rows = U.dealt(U.prepare(history_lines(order_lines(spark, sf))))
    for table in (U.cumulative(rows), U.by_marketplace(rows), U.daily_series(rows)):
        assert len(re.findall(r"hashpartitioning\([^)]*order_id[^)]*\), REPARTITION_BY_COL", plan(table))) == 1
        assert len(re.findall(r"hashpartitioning\([^)]*order_id", plan(table))) == 1


def test_cells_have_a_task_per_dimension(spark, sf):
    lines = history_lines(order_lines(spark, sf))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for dims in (("all",), ("sku", "month", "state")):
        assert "hashpartitioning(order_id" in plan(bundle.cells_of(lines, dims))
        assert f", {n * len(dims)}), REPARTITION_BY_NUM" in plan(bundle.cells_of(lines, dims))


def test_profile_merges_shuffle_nothing(spark, sf, tmp_dir):
    """Stored rows, read as they lie, are merged with the window's groups in place, in as many pieces as the run has."""
    lines = history_lines(order_lines(spark, sf))
    run_profile_job(spark, lines, tmp_dir + "/t", "1999-01-01", since="1990-01-01", n_buckets=4)
    run = BucketedRun(spark, tmp_dir + "/t", "r2")
    assert (run.buckets, run.pieces) == (4, 8)   # the session has 8 shuffle partitions
    with window_rows(U.keyed(lines), tmp_dir + "/window", run.pieces, U.with_money) as rows:
        assert rows.columns == U.prepare(lines).columns
        merged = U.merge_latest(run.read_dealt("daily", U.KEY), U.daily_series(rows), [U.KEY, "day"])
        assert "Exchange" not in plan(merged) and merged.count() == 3
        skus = rows.select(U.KEY).distinct()
        kept = run.read_dealt("status", U.KEY).join(skus.hint("shuffle_hash"), U.KEY, "left_anti")
        assert "Exchange" not in plan(kept) and kept.count() == 0
    assert not os.path.exists(tmp_dir + "/window") and not os.listdir(tmp_dir + "/t/_window")


def test_documents_are_made_and_merged_where_they_lie(spark, sf, tmp_dir):
    lines = history_lines(order_lines(spark, sf))
    D.write_profiles(lines, tmp_dir + "/t", "1999-01-01", buckets=4)
    stored = BucketedRun(spark, tmp_dir + "/t").read_dealt(D.TABLE, U.KEY)
    with window_rows(U.keyed(lines), tmp_dir + "/window", 8, U.with_money) as rows:
        assert "Exchange" not in plan(D.documents(D.section_tables(rows)))
        merged = D.merged_where_new(stored, stored, rows.select(U.KEY).distinct())
        assert "Exchange" not in plan(merged) and merged.count() == 3


def test_tables_of_an_older_layout_are_merged_by_their_own_buckets(spark, tmp_dir):
    """A manifest without pieces: buckets by another hash, files that aren't bucketed."""
    def latest(old, new):
        return new if old is None else U.merge_latest(old, new, ["k"])
    older = BucketedRun(spark, tmp_dir, "r1", 8)
    older.pieces = 0
    older.merge("t", spark.range(40).selectExpr("cast(id as string) k", "id v"), "k", latest)
    older.commit()
    again = BucketedRun(spark, tmp_dir, "r2")
    assert again.pieces == 0
    again.merge("t", spark.createDataFrame([("3", 30), ("x", 1)], "k string, v long"), "k", latest)
    again.commit()
    got = {r.k: r.v for r in BucketedRun(spark, tmp_dir).read("t").collect()}
    assert len(got) == 41 and (got["3"], got["x"], got["4"]) == (30, 1, 4)


def test_a_run_reads_and_replaces_some_buckets_of_several_runs(spark, tmp_dir):
    first = BucketedRun(spark, tmp_dir, "r1", 8)
    rows = spark.range(40).selectExpr("cast(id as string) k", "id v")
    first.replace("t", rows, "k", range(8))
    first.commit()
    second = BucketedRun(spark, tmp_dir, "r2")
    one = rows.where("k = '7'").withColumn("v", F.lit(70).cast("long"))
    [bucket] = second.touched(one, "k")
    stored = second.read_dealt("t", "k", [bucket])
    assert second.touched(stored, "k") == [bucket] and stored.count() == second.read("t", [bucket]).count()
    second.replace("t", U.merge_latest(stored, one, ["k"]), "k", [bucket])
    second.commit()
    whole = BucketedRun(spark, tmp_dir).read_dealt("t", "k")
    assert "Exchange" not in plan(whole.groupBy("k").count())
    got = {r.k: r.v for r in whole.collect()}
    assert got == {str(i): 70 if i == 7 else i for i in range(40)}


def test_stored_history_stays_where_it_lies(spark, tmp_dir):
    """A merge of invoices moves the new rows alone."""
    schema = "invoice_id string, _load_seq int, v string"
    table = BucketedRun(spark, tmp_dir + "/t", "r1", 4)
    table.merge("t", spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), (None, 1, "n")], schema), "invoice_id",
                lambda _, n: ingest.upsert(None, n, table=table))
    table.commit()
    later = BucketedRun(spark, tmp_dir + "/t", "r2")
    new = spark.createDataFrame([("a", 1, "y"), ("a", 2, "z"), (None, 1, "m")], schema)
    merged = ingest.upsert(later.read_dealt("t", "invoice_id"), new, table=later, lying=True)
    assert plan(merged).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(merged)
    assert {(r.invoice_id, r.v) for r in merged.collect()} == {("a", "z"), ("b", "x"), (None, "m")}


def test_documents_by_day_are_the_same_documents(spark, sf, tmp_dir):
    """Also where an order's id comes with two dates, or with a customer whose nation isn't there."""
    spark.createDataFrame([(5, 1, "BUILDING"), (6, 99, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string") \
        .write.mode("overwrite").parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(1, 5, "1996-01-04", "1-URGENT"), (1, 5, "1996-01-02", None), (1, 6, "1995-01-01", None),
                           (2, 5, "1996-01-03", None)], "o_orderkey long, o_custkey long, d string, o_orderpriority string") \
        .selectExpr("o_orderkey", "o_custkey", "cast(d as timestamp_ntz) o_orderdate", "o_orderpriority") \
        .write.mode("overwrite").parquet(f"{sf}/orders.parquet")
    docs, by_day = posted_orders_by_day(spark, sf)
    assert by_day and "rangepartitioning(first_date" in plan(docs) and "hashpartitioning(first_date" not in plan(docs)
    assert sorted(map(str, docs.collect())) == sorted(map(str, posted_orders(spark, sf).collect()))
    write_daily_json(docs, tmp_dir + "/landing", dealt=True)
    files = glob.glob(tmp_dir + "/landing/month=1996-01/day=*/part-*")
    assert sorted(f.split("day=")[1][:10] for f in files) == ["1996-01-02", "1996-01-03"]


def test_a_window_of_days_meets_its_orders_first(spark, sf):
    """The lines that the filter leaves out don't reach the join with parts."""
    late = order_lines(spark, sf, orders_first=True).where("order_date >= timestamp_ntz'1996-01-03'").select("order_id", "mrp")
    text = plan(late)
    assert text.index("p_partkey") < text.index("o_orderkey") and "first_date" not in text   # the plan's root is its last join
    assert [r.order_id for r in late.collect()] == [2]
