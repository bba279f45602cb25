"""Monitoring responses as points, and the window of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RESPONSE = "struct<data: struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>>"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """`<window>__<metric>.json` files as (window, metric, mode, t, v, ordinal): of CPU every mode, of others the first series. Files are read
    whole, one row each."""
    texts = spark.read.option("wholetext", True).text(f"{folder}/*__*.json").select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"))
    name = texts.select(F.regexp_extract("stem", r"^(.*?)__", 1).alias("window"), F.regexp_extract("stem", r"__(.*)$", 1).alias("metric"), F.from_json("value", RESPONSE)["data"]["result"].alias("r"))
    each = name.select("window", "metric", F.posexplode("r").alias("i", "s")).where("metric = 'cpu' or i = 0")
    value = each.select("window", "metric", F.coalesce(F.col("s.metric")["mode"], F.lit("")).alias("mode"), F.posexplode("s.values").alias("ordinal", "p"))
    return value.select("window", "metric", "mode", F.floor(F.col("p")[0].cast("double")).cast("long").alias("t"), F.col("p")[1].cast("double").alias("v"), F.col("ordinal").cast("long").alias("ordinal"))


def windows(points_: DataFrame) -> DataFrame:
    from ..operators.monitoring import window_order

    return points_.select("window").distinct().withColumn("window_ord", window_order(F.col("window")).cast("int")).orderBy("window_ord", "window")


def capture_window(calls: DataFrame, pad: int = 300) -> DataFrame:
    """Whole seconds around a capture."""
    return calls.agg((F.min("ts_start").cast("long") - pad).alias("start"), (F.max("ts_start").cast("long") + pad).alias("end"))


def label_for(stem: Column, start: Column) -> Column:
    """`26-05-26` in a file's name gives may26, else the day of its start does."""
    named = F.try_to_timestamp(F.concat(F.lit("20"), F.nullif(F.regexp_extract(stem, r"(\d\d-\d\d-\d\d)", 1), F.lit(""))), F.lit("yyyy-MM-dd"))
    return F.lower(F.date_format(F.coalesce(named, F.timestamp_seconds(start)), "MMMdd"))
