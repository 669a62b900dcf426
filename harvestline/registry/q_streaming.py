"""The streaming job."""

from pyspark.sql import functions as F

from harvestline.registry.base import query
from harvestline.registry.views import Views
from harvestline.session import scratch_path
from harvestline.streaming.ingest import read_daily, stream_ingest_daily


@query("stream_ingest_daily", "region_id param obs_date:t value:d", "SELECT * FROM odaily", "odaily")
def _(v: Views):
    """The event table as a folder of arriving files; the result equals the batch one."""
    schema = v.table("events").schema
    pick = lambda raw: raw.select("event_id", F.col("user_id").cast("string").alias("region_id"), F.col("event_type").alias("param"), "ts", "value")
    inbox, out = scratch_path(v.spark, "inbox"), scratch_path(v.spark, "daily")
    v.table("events").repartition(4).write.parquet(inbox)
    job = stream_ingest_daily(v.spark, inbox, schema, out, scratch_path(v.spark, "stream-state"), key=["event_id"], select=pick)
    job.awaitTermination()
    return read_daily(v.spark, out)
