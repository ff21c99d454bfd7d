"""Structured Streaming form of the profile job.

The history table folder is read as a file stream; ``foreachBatch`` merges
each micro-batch into the stored daily table. The stream checkpoint (in the
shared checkpoint folder) is the incremental mark: a restarted query resumes
after the last committed batch, and ``trigger(availableNow=True)`` processes
what has landed and stops — the daily run.

Exactness: a day's rows may arrive over several batches (late data). Each
batch lands its prepared rows under ``landed_rows/batch=<id>/day=<day>``
(dynamic partition overwrite, so a retried batch rewrites only itself); the
(SKU, day) keys it touches are then recomputed from every landed row of those
keys (only their days' folders are read) and replace the stored rows; only the
buckets of their SKUs are written anew. A version's folder name is unique to
the attempt; a batch whose version is committed is skipped, so a retry after
the commit changes nothing and a retry before it never meets the folder that
the first attempt left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sku_profiles as U
from ..sources import state
from ..sources.buckets import BucketedRun


def merge_landed_batch(spark: SparkSession, root: str, batch_id: int) -> None:
    """Recompute the (SKU, day) keys touched by ``batch_id`` and commit a new daily version."""
    name = f"batch-{batch_id:012d}"
    if state.is_committed(spark, root, f"{name}-"):
        return
    landed = spark.read.parquet(f"{root}/landed_rows").where(F.col("batch") <= batch_id)
    touched = landed.where(F.col("batch") == batch_id).select(U.KEY, "day").distinct()
    days = [r[0] for r in touched.select("day").distinct().collect()]   # bounded by the calendar; prunes the folders
    same_days = landed.where(F.col("day").isin(days) | F.col("day").isNull())
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (U.KEY, "day")]
    rows = same_days.drop("batch").alias("r").join(touched.alias("t"), same[0] & same[1], "left_semi")
    version = f"{name}-{uuid.uuid4().hex[:8]}"

    def replaced(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if stored is None else U.merge_latest(stored, new, [U.KEY, "day"])

    run = BucketedRun(spark, root, version)
    run.merge("daily", U.daily_series(rows), U.KEY, replaced)
    run.commit()


def start_profile_stream(spark: SparkSession, history_path: str, history_schema, root: str, checkpoint: str,
                         available_now: bool = True):
    """Start the stream over the history folder; returns the StreamingQuery."""
    stream = spark.readStream.schema(history_schema).parquet(history_path)

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        (U.prepare(batch).withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch", "day").parquet(f"{root}/landed_rows"))
        merge_landed_batch(spark, root, batch_id)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
