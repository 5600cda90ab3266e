"""The event log as a stream: counts in event time, incremental index upkeep, and reading progress per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, event_type string, event_ts timestamp_ntz, received timestamp_ntz, entry_key string, event_data string"


def read_log(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("event_ts").cast("timestamp"))


def windowed_counts(log: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """Events by type in tumbling windows; redelivered events count once, events later than ``late`` are let go."""
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), F.upper("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def keep_index(log: DataFrame, path: str, checkpoint: str):
    """Appends the changes of each batch, one row an entry, idempotently: a batch writes to the folder of its number."""

    def upsert(batch: DataFrame, number: int) -> None:
        changed = batch.where("upper(event_type) like 'ENTRY_%' and entry_key is not null")
        last = changed.groupBy(F.lower(F.trim("entry_key")).alias("entry_key")).agg(F.max(F.struct("event_ts", "event_id", F.upper("event_type").alias("change"))).alias("v")).select("entry_key", "v.change", F.col("v.event_ts").alias("at"), "v.event_id")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(log: DataFrame) -> DataFrame:
    """Reading progress of each entry as running aggregates: when it was started and when finished, each set once."""
    at = lambda t: F.min(F.when(F.upper("event_type") == t, F.col("ts")))
    return log.where("entry_key is not null").groupBy(F.lower(F.trim("entry_key")).alias("entry_key")).agg(at("ENTRY_CREATED").alias("started"), at("METADATA_UPDATED").alias("finished"), F.count(F.lit(1)).alias("n"))
