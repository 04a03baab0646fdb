"""Crawl relations on the shared test tables: what plays the part of dispatch, crawl and telemetry logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", epoch(F.col("ts"))).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dispatch_ts, slot_id, url, monotonic_ts."""
    slot = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://"), slot, F.lit("/"), "event_type", F.lit("/"), F.col("event_id").cast("string"))
    return events(spark, sf_dir).select(F.col("t").alias("dispatch_ts"), slot.alias("slot_id"), url.alias("url"), F.col("t").alias("monotonic_ts"), "event_id")


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_ts, recv_ts, url, slot_id, status, content_type, n_links, bytes."""
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "signup", "201").otherwise("200")
    e = events(spark, sf_dir)
    slot = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://"), slot, F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 1000).cast("string"))
    return e.select(
        F.col("t").alias("sent_ts"), (F.col("t") + F.col("value") / 10).alias("recv_ts"), url.alias("url"), slot.alias("slot_id"), status.alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.col("k").alias("n_links"), (F.col("event_id") % 4096).alias("bytes"), "event_id",
    )


def runstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, seq, elapsed, crawled, discovered: running counts of each shard's telemetry."""
    e = events(spark, sf_dir).withColumn("shard", (F.col("user_id") % 2).cast("int"))
    w = Window.partitionBy("shard").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = e.agg(F.min("t")).first()[0]
    return e.select("shard", F.col("event_id").alias("seq"), (F.col("t") - F.lit(start)).alias("elapsed"), F.count("*").over(w).alias("crawled"), F.sum("k").over(w).alias("discovered"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, seq, arrive, rtt: requests as they reach a frontier."""
    return events(spark, sf_dir).select(F.col("user_id").alias("slot"), F.col("event_id").alias("seq"), F.col("t").alias("arrive"), F.col("value").alias("rtt"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dispatch log lines, some short, some without a stamp, some unreadable: (line)."""
    d = dispatched(spark, sf_dir)
    stamp = F.when(F.col("event_id") % 97 == 0, "NA").when(F.col("event_id") % 89 == 0, "x").otherwise(F.format_string("%.3f", "dispatch_ts"))
    full = F.concat_ws("\t", stamp, "slot_id", "url", F.format_string("%.6f", "monotonic_ts"))
    return d.select(F.when(F.col("event_id") % 83 == 0, stamp).when(F.col("event_id") % 2 == 0, F.concat_ws("\t", stamp, "slot_id", "url")).otherwise(full).alias("line"), "event_id")
