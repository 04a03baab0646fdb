"""Compliance audits of crawl logs: minimum gap, guard replay, refetches, shard ownership."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS


def gaps(rows: DataFrame, key: str = "slot_id", ts: str = "dispatch_ts", tie: str = "event_id") -> DataFrame:
    """rows with gap: seconds since the key's previous row."""
    return rows.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie)))


def politeness_verdict(rows: DataFrame, min_gap: float = DEFAULTS.min_gap, uncheckable: int = 0) -> DataFrame:
    """requests, domains, min_gap, violations, uncheckable, ok: one row."""
    short = F.col("gap") < min_gap - DEFAULTS.tolerance
    out = gaps(rows).agg(F.count("*").alias("requests"), F.count_distinct("slot_id").alias("domains"), F.min("gap").alias("min_gap"), F.count_if(short).alias("violations"))
    return out.withColumn("uncheckable", F.lit(uncheckable).cast("long")).withColumn("ok", (F.col("violations") == 0) & (F.col("uncheckable") == 0))


def violations(rows: DataFrame, min_gap: float, show: int = 20) -> DataFrame:
    """The `show` shortest gaps under the minimum; not_shown: how many more there are."""
    short = gaps(rows).where(F.col("gap") < min_gap - DEFAULTS.tolerance)
    more = F.greatest(short.agg(F.count("*")).scalar() - show, F.lit(0))
    return short.orderBy("gap", "slot_id", "dispatch_ts").limit(show).withColumn("not_shown", more)


def guard_replay(rows: DataFrame, min_gap: float) -> DataFrame:
    """rows with accepted: a request passes if its key's last accepted one is min_gap (less tolerance) ago. Refused ones don't count.

    A key's rows are one sequence by nature; they stream through a task in order, and nothing is held but the last stamp.
    """
    least, out = min_gap - DEFAULTS.tolerance, "slot_id string, dispatch_ts double, event_id long, accepted boolean"

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, float("-inf")
        for frame in frames:
            passed = []
            for slot, ts in zip(frame["slot_id"], frame["dispatch_ts"], strict=True):
                if slot != key:
                    key, last = slot, float("-inf")
                ok = ts - last >= least
                if ok:
                    last = ts
                passed.append(ok)
            yield frame.assign(accepted=passed)

    ordered = rows.select("slot_id", "dispatch_ts", "event_id").repartition("slot_id").sortWithinPartitions("slot_id", "dispatch_ts", "event_id")
    return ordered.mapInPandas(replay, out)


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """Keys found more than once, with how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def refetch_summary(rows: DataFrame, key: str) -> DataFrame:
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("rows"), F.count("*").alias("urls"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).alias("wasted"))


def ownership(rows: DataFrame, key: str, shard: str) -> DataFrame:
    """How many shards have rows of each key; each key should have one."""
    return rows.groupBy(key).agg(F.count_distinct(shard).alias("shards"))


def exit_code(verdict: DataFrame) -> DataFrame:
    """verdict with code: 0 clean, 1 violations or rows that can't be checked, 2 nothing to check."""
    return verdict.withColumn("code", F.when(F.col("requests") == 0, 2).when(F.col("ok"), 0).otherwise(1))
