"""The ledger as a stream: events once, counted by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """The ledger's files as a stream, with the event's time. The schema is that of the files present."""
    schema = spark.read.parquet(f"{folder}/request_ledger.parquet").schema
    # as a pattern, the path may be a file as well as a folder of files
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/request_ledger.parque[t]")
    return rows.withColumn("at", F.to_timestamp("ts_utc"))


def first_deliveries(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each event of an attempt once, if its deliveries lie within delay of the latest event time; state older than that
    goes. For consumers that need each event soon: what arrives later than delay is dropped (numRowsDroppedByWatermark
    of the query's progress counts it), and only keyed_deliveries has it."""
    return events.where("ledger_id is not null and at is not null").withWatermark("at", delay).dropDuplicatesWithinWatermark(["ledger_id", "event"])


def keyed_deliveries(events: DataFrame, path: str, checkpoint: str):
    """The started query that writes the keys (day, ledger_id, event) of each micro-batch, once each, under the batch's
    number, so that one that is repeated after a failure replaces itself. It keeps no state, however late rows come."""

    def keep(batch: DataFrame, number: int) -> None:
        keys = batch.where("ledger_id is not null and at is not null").select(F.date_format("at", "yyyy-MM-dd").alias("day"), "ledger_id", "event").distinct()
        keys.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_days(spark: SparkSession, folder: str) -> DataFrame:
    """Runs the stream over all files present and gives (day, event, n): distinct events of distinct attempts."""
    base = new_path(spark, "stream")
    keyed_deliveries(event_stream(spark, folder), f"{base}/keys", f"{base}/checkpoint").awaitTermination()
    keys = spark.read.schema("day string, ledger_id string, event string, batch int").parquet(f"{base}/keys")
    return keys.select("day", "ledger_id", "event").distinct().groupBy("day", "event").agg(F.count("*").alias("n"))
