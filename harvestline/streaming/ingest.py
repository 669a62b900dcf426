"""Incremental ingest of observation files."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

BY = ("region_id", "param")
BUCKETS = 64  # of the ledger of keys; a batch reads those that its own keys fall in
FAN = 8       # folders of the ledger that are merged to one of the next level


def daily_stream(spark: SparkSession, in_path: str, schema: T.StructType, *, by: Sequence[str] = BY, ts: str = "ts",
                 value: str = "value", key: Sequence[str] | None = None, watermark: str = "40 days",
                 select: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Running daily means kept in the state store, for a live view. Repeats are dropped
    and days updated while they are within the watermark; rows later than that are not
    taken, so the complete record is kept by ``stream_ingest_daily``."""
    obs = _observations(spark, in_path, schema, ts, select)
    once = obs.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key or [*by, ts, value]))
    day = F.window(ts, "1 day")
    return once.groupBy(*by, day.alias("_w")).agg(F.avg(value).alias(value)) \
        .select(*by, F.to_date("_w.start").alias("obs_date"), value)


def _observations(spark, in_path, schema, ts, select, files_per_batch=None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(in_path)
    # watermarks need a timestamp with time zone
    return (select(raw) if select else raw).withColumn(ts, F.col(ts).cast("timestamp"))


def live_ranges(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Ranges of batches that together hold the batches before ``batch``: the digits of the number
    in base ``fan``, so at most ``fan - 1`` ranges of each size."""
    sizes = [1]
    while sizes[-1] * fan <= batch:
        sizes.append(sizes[-1] * fan)
    out, at = [], 0
    for size in reversed(sizes):
        while at + size <= batch:
            out.append((at, at + size))
            at += size
    return out


def merged_ranges(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Ranges that become complete with the batch before ``batch``, small ones first."""
    out, size = [], fan
    while batch and batch % size == 0:
        out.append((batch - size, batch))
        size *= fan
    return out


class KeyLedger:
    """Keys of earlier batches in folders by range of batches, each cut into buckets by a hash of
    the key with one file a bucket. Every ``fan`` folders of a size are merged to one, so a batch
    looks into ``fan - 1`` folders a level and there into its own buckets only. Which folders
    exist follows from the batch number: a repeated batch writes the same folders again."""

    def __init__(self, path: str, fields: Sequence[T.StructField], buckets: int = BUCKETS, fan: int = FAN):
        self.path, self.buckets, self.fan = path, buckets, fan
        self.ids = [f.name for f in fields]
        self.schema = T.StructType([*fields, T.StructField("_bucket", T.IntegerType())])

    def folder(self, lo: int, hi: int) -> str:
        return f"{self.path}/{lo}-{hi}"

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.ids), F.lit(self.buckets)).cast("int"))

    def read(self, spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.schema(self.schema).parquet(self.folder(*r)) for r in ranges])

    def write(self, keys: DataFrame, lo: int, hi: int) -> None:
        dealt = keys.select(*self.ids, "_bucket").repartition(self.buckets, "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(self.folder(lo, hi))

    def merge(self, spark: SparkSession, batch: int) -> None:
        """Merges what the batch before has completed."""
        for lo, hi in merged_ranges(batch, self.fan):
            step = (hi - lo) // self.fan
            self.write(self.read(spark, [(at, at + step) for at in range(lo, hi, step)]), lo, hi)

    def known(self, spark: SparkSession, batch: int, used: Sequence[int]) -> DataFrame | None:
        """Keys before the batch, of the buckets ``used`` (at most ``buckets`` numbers)."""
        ranges = live_ranges(batch, self.fan)
        return self.read(spark, ranges).where(F.col("_bucket").isin(list(used))) if ranges and used else None


def stream_ingest_daily(spark: SparkSession, in_path: str, schema: T.StructType, out_path: str, checkpoint: str, *,
                        by: Sequence[str] = BY, ts: str = "ts", value: str = "value", key: Sequence[str] | None = None,
                        select: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, fan: int = FAN,
                        files_per_batch: int | None = None) -> StreamingQuery:
    """Takes all files not seen yet and stops; nothing is too late.

    A batch keeps the observations whose key no earlier batch has, whatever day they had then
    (the first delivery counts; of deliveries in one batch, the one with the smallest time and
    value), and adds their keys to a ``KeyLedger`` and their daily sums and counts to a table.
    NULL keys are equal to each other. Sums and counts, unlike means, add up over batches. A batch
    that is repeated after a failure overwrites its own output only. ``buckets`` and ``fan`` belong
    to the ledger: later runs on the same folder must give the same."""
    ids = list(key or [*by, ts, value])
    obs = _observations(spark, in_path, schema, ts, select, files_per_batch)
    sums_path = f"{out_path}/sums"
    ledger = KeyLedger(f"{out_path}/keys", [obs.schema[c] for c in ids], buckets, fan)
    columns = list(dict.fromkeys([ts, value, *by, *ids]))

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        ledger.merge(session, batch_id)
        first = ledger.bucketed(batch.select(*columns)).groupBy(*ids, "_bucket").agg(F.min(F.struct(*columns)).alias("_first"))
        first = first.persist()
        try:
            used = [r[0] for r in first.select("_bucket").distinct().collect()]
            known = ledger.known(session, batch_id, used)
            fresh = first
            if known is not None:
                same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ["_bucket", *ids]])
                fresh = first.alias("n").join(known.alias("k"), same, "left_anti")
            fresh = fresh.persist()
            try:
                ledger.write(fresh, batch_id, batch_id + 1)
                rows = fresh.select("_first.*").withColumn("obs_date", F.to_date(ts))
                sums = rows.groupBy(*by, "obs_date").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
                (sums.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sums_path))
            finally:
                fresh.unpersist()
        finally:
            first.unpersist()

    return obs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily(spark: SparkSession, out_path: str, by: Sequence[str] = BY) -> DataFrame:
    """Daily means over all batches."""
    parts = spark.read.parquet(f"{out_path}/sums")
    return parts.groupBy(*by, "obs_date").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("value"))
