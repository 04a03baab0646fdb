"""Telemetry and run control: counters, sampled quantiles, CPU shares, failure streaks, queue names, run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.operators.robots import failure_ttl


def counters(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """What a stats collector holds: increments summed, maximum and last set value of each metric. `seq` orders the settings."""
    return rows.groupBy(metric).agg(F.sum(value).alias("total"), F.max(value).alias("highest"), F.max_by(F.col(value), F.col("seq")).alias("latest"))


def sampled_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key sorted(values)[n // 2] and the maximum."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(value))).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    return ranked.groupBy(*key).agg(F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col(value))).alias("median"), F.max(value).alias("highest"))


def rates(rows: DataFrame, key: str, order: str, ticks: str, per_second: float = 100.0) -> DataFrame:
    """Share of a CPU between consecutive samples, in percent, from a counter of ticks; null for the first sample and for no time. Samples of one time come by their ticks."""
    w = Window.partitionBy(key).orderBy(order, ticks)
    span = F.col(order) - F.lag(order).over(w)
    return rows.withColumn("percent", F.when(span > 0, 100 * (F.col(ticks) - F.lag(ticks).over(w)) / per_second / span))


def failure_streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each failure with its number since the last success of its key, and how long the negative entry then holds."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("failed", failed).withColumn("era", F.sum((~F.col("failed")).cast("int")).over(w))
    nth = F.sum(F.col("failed").cast("int")).over(Window.partitionBy(key, "era").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("failures", nth).where("failed").withColumn("ttl", failure_ttl(F.col("failures"))).drop("failed", "era")


def queue_folder(slot: Column) -> Column:
    """The folder name of a slot's queue: the name with unsafe characters as underscores, a dash, the MD5 of the name."""
    return F.concat(F.regexp_replace(slot, r"[^a-zA-Z0-9._]", "_"), F.lit("-"), F.md5(slot))


def slot_of_folder(folder: Column) -> Column:
    """The slot of a queue folder, null if its MD5 shows that the name was changed."""
    head, tail = F.regexp_extract(folder, "^(.*)-([^-]*)$", 1), F.regexp_extract(folder, "^(.*)-([^-]*)$", 2)
    return F.when((head != "") & (F.md5(head) == tail), head)


def run_action(reason: Column, code: Column, crashes: Column, limit: int = 10) -> Column:
    """What a supervisor does after a round: done, restart or stop."""
    return (
        F.when(code != 0, F.when(crashes < limit, "restart").otherwise("stop"))
        .when(F.coalesce(reason, F.lit("")).isin("", "run_duration"), "done")
        .when(reason == "memusage_exceeded", "restart")
        .otherwise("stop")
    )


def finish_reason(stats: Column) -> Column:
    """The reason in a JSON dump of flat statistics."""
    return F.get_json_object(stats, "$.finish_reason")


def histogram(rows: DataFrame, kind: str, top: int = 15) -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(top)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(json): each row as one JSON object, nulls left out."""
    return metrics.select(F.to_json(F.struct("*")).alias("json"))
