"""The replay report over a growing folder of calls: counters kept by Structured Streaming, and the slowest flows kept by merging batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as x
from ..schema import CALLS_SCHEMA


def calls_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CALLS_SCHEMA).parquet(folder)


def method_counters(calls: DataFrame) -> DataFrame:
    """Calls and errors by method; the state is one row a method."""
    return calls.groupBy("method").agg(F.count("*").alias("calls"), F.count("error_code").alias("errors"))


def bucket_counters(calls: DataFrame) -> DataFrame:
    """Flows by batch bucket: the row at position 0 stands for its flow, so no flow ids are kept."""
    return calls.where("position = 0").groupBy(x.replay_bucket(F.col("batch_size")).alias("bucket")).agg(F.count("*").alias("flows"))


def hourly(calls: DataFrame, late: str | None = None) -> DataFrame:
    """Calls and errors by hour; with a bound on lateness, hours beyond it are closed and their state freed."""
    timed = calls.where("ts_start is not null").withColumn("at", F.timestamp_seconds("ts_start"))
    if late:
        timed = timed.withWatermark("at", late)
    hours = timed.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("calls"), F.count("error_code").alias("errors"))
    return hours.select(F.unix_timestamp(F.col("w.start")).alias("hour_start"), "calls", "errors")


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there; the result is the in-memory table `name`."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slowest_flows(calls: DataFrame, into: str, checkpoint: str, k: int = 20) -> StreamingQuery:
    """Keep the k slowest flows (equal durations by flow_id) as Parquet in folders `into/<batch>`; the last is current. Each batch reduces itself
    to k rows before it meets the k kept so far; a batch that runs again gives the same."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.where("position = 0 and duration_ms is not null").select("flow_id", "duration_ms", "batch_size", "method")
        best = own.orderBy(F.desc("duration_ms"), "flow_id").limit(k)
        if batch_id:
            best = best.unionByName(spark.read.parquet(f"{into}/{batch_id - 1}")).dropDuplicates(["flow_id"]).orderBy(F.desc("duration_ms"), "flow_id").limit(k)
        best.coalesce(1).write.mode("overwrite").parquet(f"{into}/{batch_id}")

    return calls.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
