from pyspark.sql import functions as F

from harvestline.operators.timeseries import resample_daily
from harvestline.session import scratch_path
from harvestline.streaming.ingest import KeyLedger, daily_stream, live_ranges, merged_ranges, read_daily, stream_ingest_daily

EVENTS = "/root/testdata/sf0.001/events.parquet"


def pick(raw):
    return raw.select("event_id", F.col("user_id").cast("string").alias("region_id"), F.col("event_type").alias("param"), "ts", "value")


def run(spark, inbox, out, state):
    schema = spark.read.parquet(EVENTS).schema
    stream_ingest_daily(spark, inbox, schema, out, state, key=["event_id"], select=pick).awaitTermination()


def as_dict(df):
    return {(r.region_id, r.param, r.obs_date): round(r.value, 6) for r in df.collect()}


def batch_result(events):
    return as_dict(resample_daily(pick(events).withColumn("ts", F.col("ts").cast("timestamp"))))


def test_restarted_stream_equals_batch(spark):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    events = spark.read.parquet(EVENTS)
    events.where("event_id >= 400").write.parquet(inbox)
    run(spark, inbox, out, state)
    events.where("event_id < 500").write.mode("append").parquet(inbox)  # 100 rows arrive twice
    run(spark, inbox, out, state)
    assert as_dict(read_daily(spark, out)) == batch_result(events)
    run(spark, inbox, out, state)  # nothing new
    assert as_dict(read_daily(spark, out)) == batch_result(events)


def test_very_late_files_still_count(spark):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    events = spark.read.parquet(EVENTS)
    old = events.withColumns({"ts": F.col("ts") - F.expr("interval 400 days"), "event_id": F.col("event_id") + 1_000_000})
    events.write.parquet(inbox)
    run(spark, inbox, out, state)
    old.write.mode("append").parquet(inbox)
    run(spark, inbox, out, state)
    assert as_dict(read_daily(spark, out)) == batch_result(events.unionByName(old))


def test_live_view_equals_batch(spark):
    inbox = scratch_path(spark, "inbox")
    events = spark.read.parquet(EVENTS)
    events.unionByName(events).write.parquet(inbox)
    live = daily_stream(spark, inbox, events.schema, key=["event_id"], select=pick)
    job = live.writeStream.outputMode("complete").format("memory").queryName("live_days").trigger(availableNow=True).start()
    job.awaitTermination()
    assert as_dict(spark.table("live_days")) == batch_result(events)


def test_an_event_that_returns_on_another_day_counts_once(spark):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    events = spark.read.parquet(EVENTS)
    events.write.parquet(inbox)
    run(spark, inbox, out, state)
    events.where("event_id < 50").withColumn("ts", F.col("ts") + F.expr("interval 3 days")).write.mode("append").parquet(inbox)
    run(spark, inbox, out, state)
    assert as_dict(read_daily(spark, out)) == batch_result(events)


def test_ranges_hold_every_batch_once():
    for fan in (2, 3, 8):
        made = set()
        for b in range(70):
            made |= set(merged_ranges(b, fan))
            ranges = live_ranges(b, fan)
            assert [x for lo, hi in ranges for x in range(lo, hi)] == list(range(b))
            assert all(r in made or r[1] - r[0] == 1 for r in ranges)
            levels = len({hi - lo for lo, hi in ranges})
            assert len(ranges) <= (fan - 1) * levels


def test_files_read_per_batch_stay_bounded(spark):
    """One file per batch, 12 batches: folders are merged, a key's batch reads its bucket only, and
    a key that comes back in the last file counts once."""
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    events = spark.read.parquet(EVENTS)
    some = events.where("event_id < 110").coalesce(1).cache()
    for i in range(11):
        some.where(f"event_id >= {10 * i} and event_id < {10 * i + 10}").coalesce(1).write.mode("append").parquet(inbox)
    run_small = lambda: stream_ingest_daily(spark, inbox, events.schema, out, state, key=["event_id"], select=pick, buckets=4, fan=3, files_per_batch=1).awaitTermination()
    run_small()
    some.where("event_id = 5").coalesce(1).write.mode("append").parquet(inbox)
    run_small()
    ledger = KeyLedger(f"{out}/keys", [pick(events).schema["event_id"]], 4, 3)
    for b in (5, 11):
        folders = live_ranges(b, 3)
        assert len(folders) <= 4
        assert len(ledger.known(spark, b, [0, 1, 2, 3]).inputFiles()) <= 4 * len(folders)
        own = ledger.known(spark, b, [1])  # folders of other buckets are not opened: a partition filter, not a row filter
        scans = [line for line in own._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
        assert len(scans) == len(folders) and all("(_bucket" in line.split("PartitionFilters:")[1].split("]")[0] for line in scans)
    ledger.merge(spark, 12)  # as the next batch would
    assert sorted(r.event_id for r in ledger.known(spark, 12, [0, 1, 2, 3]).collect()) == sorted(r.event_id for r in some.collect())
    assert as_dict(read_daily(spark, out)) == batch_result(some)


def test_the_smallest_of_two_deliveries_in_a_batch_counts(spark):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    events = spark.read.parquet(EVENTS).where("event_id < 40")
    more = events.withColumn("value", F.col("value") + 1000)
    more.unionByName(events).repartition(3).write.parquet(inbox)
    run(spark, inbox, out, state)
    assert as_dict(read_daily(spark, out)) == batch_result(events)
