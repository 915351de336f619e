"""Streams: windowed counts with late data, deduplication and running totals. An extension; batch tables are the core."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusverk.plans.runtime import ensure_checkpoint_dir


def read_folder(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The table's files in the folder as a stream; times without zone are taken in the session's zone."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", stream["ts"].cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """late: None where the stream has its watermark already, as after once()."""
    return (events.withWatermark("ts", late) if late else events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """Per user the number and sum of events so far, emitted at each update."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))


def drain(stream: DataFrame, name: str, mode: str = "append", run: str | None = None) -> DataFrame:
    """Runs the stream over all that is there now, into files in the shared checkpoint folder; returns what was written.

    run names the state: a restart under the same name and run goes on where the last one stopped, in append mode by the file sink's log and in update
    mode by one folder for each epoch, which a repeated epoch overwrites, so rows are neither dropped nor repeated. Without it the run is a new one.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{name}-{run or uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", base + "/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", base + "/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(base + "/out")
    writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")).start().awaitTermination()
    return spark.read.parquet(base + "/out").withColumnRenamed("epoch", "_epoch")
