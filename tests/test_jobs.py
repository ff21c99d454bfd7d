"""Incremental jobs: merge idempotence, two-run job == one-shot, streaming == batch."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderlens.operators import sku_profiles as U
from orderlens.plans.presets import PRESET_30D, precompute_presets, resolve_preset
from orderlens.plans.profile_job import run_profile_job
from orderlens.sources import ingest, state
from orderlens.sources.buckets import BucketedRun
from orderlens.sources.history import history_lines
from orderlens.sources.nested import posted_orders
from orderlens.sources.tables import order_lines

from paths import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _history(spark):
    return history_lines(order_lines(spark, SF_SMALL))


def test_merge_is_idempotent(spark):
    daily = U.daily_series(U.prepare(_history(spark)))
    assert _rows(U.merge_latest(daily, daily, [U.KEY, "day"])) == _rows(daily)


def test_two_runs_equal_one_shot(spark, tmp_dir):
    h = _history(spark)
    run_profile_job(spark, h.where(F.col("order_date") < F.lit("1998-01-01").cast("timestamp_ntz")), tmp_dir, "1998-01-01")
    assert state.read_last_run(spark, tmp_dir) == "1998-01-01"
    run_profile_job(spark, h, tmp_dir, "2002-01-01", since="1997-12-01")
    assert state.read_last_run(spark, tmp_dir) == "2002-01-01"
    one_shot = U.daily_series(U.prepare(h))
    assert _rows(state.read_table(spark, tmp_dir, "daily")) == _rows(one_shot)
    from orderlens.plans.profile_job import cumulative_from_daily
    cum = {r.canonical_sku: r for r in state.read_table(spark, tmp_dir, "cumulative").collect()}
    direct = {r.canonical_sku: r for r in U.cumulative(U.prepare(h)).collect()}
    assert cum.keys() == direct.keys()
    for k, r in direct.items():
        assert abs(cum[k].total_revenue - r.total_revenue) < 0.011 and cum[k].total_orders == r.total_orders
    del cumulative_from_daily


def test_streaming_available_now_matches_batch(spark, tmp_dir):
    from orderlens.streaming.profile_stream import start_profile_stream
    h = _history(spark)
    src = tmp_dir + "/history"
    h.where(F.col("order_date") < F.lit("1998-01-01").cast("timestamp_ntz")).write.parquet(src + "/part=1")
    schema = spark.read.parquet(src).schema
    q = start_profile_stream(spark, src, schema, tmp_dir + "/profiles", tmp_dir + "/ckpt")
    q.awaitTermination(300)
    h.where(F.col("order_date") >= F.lit("1998-01-01").cast("timestamp_ntz")).write.parquet(src + "/part=2")
    q = start_profile_stream(spark, src, schema, tmp_dir + "/profiles", tmp_dir + "/ckpt")
    q.awaitTermination(300)
    got = state.read_table(spark, tmp_dir + "/profiles", "daily")
    assert _rows(got) == _rows(U.daily_series(U.prepare(h)))


def test_retried_stream_batch_changes_nothing(spark, tmp_dir):
    from orderlens.streaming.profile_stream import merge_landed_batch
    h = _history(spark)
    rows = U.prepare(h).withColumn("batch", F.lit(0))
    rows.write.partitionBy("batch", "day").parquet(tmp_dir + "/landed_rows")
    merge_landed_batch(spark, tmp_dir, 0)
    before, version = _rows(state.read_table(spark, tmp_dir, "daily")), state.current_version(spark, tmp_dir)
    merge_landed_batch(spark, tmp_dir, 0)   # the stream retries a batch that had been committed
    assert state.current_version(spark, tmp_dir) == version
    assert _rows(state.read_table(spark, tmp_dir, "daily")) == before == _rows(U.daily_series(U.prepare(h)))


def test_a_version_is_never_overwritten(spark, tmp_dir):
    df = spark.range(3)
    state.write_tables(spark, tmp_dir, "v1", {"t": df})
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        state.write_tables(spark, tmp_dir, "v1", {"t": df})


def test_only_a_missing_path_means_no_table(spark, tmp_dir):
    assert state.read_table(spark, tmp_dir + "/none", "t") is None
    os.makedirs(tmp_dir + "/_current")
    with open(tmp_dir + "/_current/part-0.parquet", "wb") as f:
        f.write(b"not a table")
    with pytest.raises(Exception):
        state.current_version(spark, tmp_dir)


def test_presets_snapshot(spark, tmp_dir):
    today = datetime(2001, 7, 31, 12)
    assert resolve_preset("2001-07-02", "2001-07-31", None, today) == PRESET_30D
    assert resolve_preset("2001-07-02", "2001-07-31", {"state": "x"}, today) is None
    h = _history(spark)
    precompute_presets(h, tmp_dir, "history", today, "v9", all_time_start="1995-01-01 00:00:00")
    precompute_presets(h, tmp_dir, "history", today, "v10", all_time_start="1995-01-01 00:00:00")
    snap = state.read_latest_snapshot(spark, tmp_dir, "history", PRESET_30D)
    assert snap.select("version").distinct().collect()[0][0] == "v10" and snap.count() == 9


def _files(spark, root, name):
    """Every data file of a table, by bucket, as the committed manifest names them."""
    folders = {b: f"{root}/{name}/run={r}/_bucket={b}" for b, r in BucketedRun(spark, root).entries[name].items()}
    return {b: sorted(f"{p}/{f}" for f in os.listdir(p) if f.endswith(".parquet")) for b, p in folders.items()}


def _text_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


TABLES = ("daily", "price_history", "cumulative", "rolling", "status", "payment", "marketplace", "state", "size", "fulfilment")


def test_a_run_rewrites_only_the_buckets_of_its_skus(spark, tmp_dir):
    h = _history(spark)
    before_day, from_day = (F.lit(d).cast("timestamp_ntz") for d in ("2001-07-20", "2001-07-30"))
    first = h.where(F.col("order_date") < before_day)
    run_profile_job(spark, first, tmp_dir, "2001-07-20", since="1990-01-01", n_buckets=200)
    before = {t: _files(spark, tmp_dir, t) for t in TABLES}
    last = U.prepare(h.where(F.col("order_date") >= from_day))
    touched = set(BucketedRun(spark, tmp_dir).touched(last, U.KEY))
    assert 0 < len(touched) < 150
    version = run_profile_job(spark, h, tmp_dir, "2001-08-01", since="2001-07-30")
    for t in TABLES:
        after = _files(spark, tmp_dir, t)
        assert {b for b in after if after[b] != before[t].get(b)} == touched, t
        assert {int(f.split("=")[1]) for f in os.listdir(f"{tmp_dir}/{t}/run={version}") if f.startswith("_bucket")} == touched
    kept = U.prepare(h.where((F.col("order_date") < before_day) | (F.col("order_date") >= from_day)))
    assert _rows(state.read_table(spark, tmp_dir, "daily")) == _rows(U.daily_series(kept))
    skus = {r[0] for r in last.select(U.KEY).distinct().collect()}
    payment = state.read_table(spark, tmp_dir, "payment")
    assert (_text_rows(payment.where(~F.col(U.KEY).isin(*skus)))
            == _text_rows(U.payment_split(U.prepare(first)).where(~F.col(U.KEY).isin(*skus))))
    assert _text_rows(payment.where(F.col(U.KEY).isin(*skus))) == _text_rows(U.payment_split(last))


def test_a_run_without_new_rows_changes_no_file(spark, tmp_dir):
    h = _history(spark)
    run_profile_job(spark, h, tmp_dir, "2002-01-01", since="2001-07-01", n_buckets=16)
    before = {t: (_files(spark, tmp_dir, t), _text_rows(state.read_table(spark, tmp_dir, t))) for t in TABLES}
    run_profile_job(spark, h, tmp_dir, "2003-01-01", since="2002-06-01")
    assert {t: (_files(spark, tmp_dir, t), _text_rows(state.read_table(spark, tmp_dir, t))) for t in TABLES} == before


def test_extraction_rewrites_only_the_buckets_of_its_invoices(spark, tmp_dir):
    docs, root = posted_orders(spark, SF_SMALL), f"{tmp_dir}/table"
    ingest.run_extraction(spark, docs, f"{tmp_dir}/a", root, "1995-01-01", "2001-06-30", n_buckets=100).collect()
    before = _files(spark, root, "history")
    again = docs.where(F.to_date("order_date").between(F.lit("2001-06-29"), F.lit("2001-07-02"))).count()
    changed_docs = docs.withColumn("payment_mode", F.lit("changed"))
    ingest.run_extraction(spark, changed_docs, f"{tmp_dir}/b", root, "2001-06-29", "2001-07-02").collect()
    after, table = _files(spark, root, "history"), state.read_table(spark, root, "history")
    changed = {b for b in after if after[b] != before.get(b)}
    new = table.where("payment_mode = 'changed'")
    assert new.count() == again > 0 and changed == set(BucketedRun(spark, root).touched(new, "invoice_id")) and len(changed) < 100
    assert table.count() == table.select("invoice_id").distinct().count()


def test_buckets_with_new_columns_read_together(spark, tmp_dir):
    first = BucketedRun(spark, tmp_dir, "r1", 8)
    first.merge("t", spark.createDataFrame([(str(i), i) for i in range(40)], "k string, a int"), "k", lambda old, new: new)
    first.commit()
    second = BucketedRun(spark, tmp_dir, "r2")
    new = spark.createDataFrame([("3", 30, "x")], "k string, a int, b string")
    assert len(second.merge("t", new, "k", lambda old, new: U.merge_latest(
        old.withColumn("b", F.lit(None).cast("string")), new, ["k"]))) == 1
    now = BucketedRun(spark, tmp_dir).read("t")   # not committed: readers see the first run
    assert now.count() == 40 and now.columns == ["k", "a"]
    second.commit()
    got = {r.k: (r.a, r.b) for r in state.read_table(spark, tmp_dir, "t").collect()}
    assert len(got) == 40 and got["3"] == (30, "x") and got["4"] == (4, None)
