"""Incremental history: changes of a day per type as a stream of files, an extension over the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

CLOSING = "closing"


def daily_changes(spark: SparkSession, path: str, lateness_days: int = 2) -> DataFrame:
    """Runs a stream over the event files that there are and returns its table: one row per type and day.

    Events are dropped as repeated by their id within the watermark and counted in day windows; each micro-batch's
    closed windows are appended. After the files one closing event, later than all by more than the lateness, is sent through
    the same query, so that the stream itself closes every day; its own day stays open and is never written.
    """
    schema = spark.read.parquet(path).schema
    folder = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    columns = ["event_id", "ts", "event_type"]
    last = spark.read.parquet(path).agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast(schema["event_id"].dataType).alias("event_id"), (F.col("ts") + F.make_interval(days=F.lit(lateness_days + 2))).alias("ts"),
        F.lit(CLOSING).alias("event_type")).where("ts IS NOT NULL")
    last.limit(0).write.parquet(f"{folder}/end")
    stream = lambda where, n: spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(where).select(*columns)
    both = stream(path.rstrip("/") + "*", 8).union(stream(f"{folder}/end", 8))
    events = both.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{lateness_days} days").dropDuplicatesWithinWatermark(["event_id"])
    counts = events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("changes"))

    def run() -> None:
        q = (counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/closed")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    last.write.mode("append").parquet(f"{folder}/end")
    run()
    closed = spark.read.schema("window struct<start:timestamp,end:timestamp>, event_type string, changes long").parquet(f"{folder}/closed")
    return closed.where(F.col("event_type") != CLOSING).select("event_type", F.to_date("window.start").cast("string").alias("day"), "changes",
                                                              F.col("changes").alias("commits"))
