"""Structured Streaming forms of deduplication, the dispatch guard, per-domain counters and the shard exchange."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkfrontier.config import DEFAULTS
from sparkfrontier.functions.domains import shard_of
from sparkfrontier.functions.urls import fingerprint


def dedup(urls: DataFrame, url: str = "url") -> DataFrame:
    """A stream of URLs without those seen before, exactly: state keeps every fingerprint."""
    return urls.withColumn("fp", fingerprint(F.col(url))).dropDuplicates(["fp"])


def dedup_within(urls: DataFrame, url: str, ts: str, delay: str) -> DataFrame:
    """As dedup, with state bounded by a watermark: a URL may come again after `delay`."""
    return urls.withColumn("fp", fingerprint(F.col(url))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["fp"])


def guard(rows: DataFrame, min_gap: float = DEFAULTS.min_gap, expire: bool = True) -> DataFrame:
    """A stream of (slot_id, dispatch_ts, event_id) with accepted; state is the last accepted stamp of a key.

    Rows of a key count in the order of their stamps within a batch. State of a key goes when it has been idle for the gap
    twice over, as it can't refuse anything any more; a stream that is to end (availableNow) needs expire=False, as open timeouts
    keep it running.
    """
    least = min_gap - DEFAULTS.tolerance

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values(["dispatch_ts", "event_id"], kind="stable")
        passed = []
        for ts in rows["dispatch_ts"]:
            ok = ts - last >= least
            last = ts if ok else last
            passed.append(ok)
        state.update((last,))
        if expire:
            state.setTimeoutDuration(max(1000, int(2000 * min_gap)))
        yield rows.assign(accepted=passed)

    return rows.select("slot_id", "dispatch_ts", "event_id").groupBy("slot_id").applyInPandasWithState(
        step, "slot_id string, dispatch_ts double, event_id long, accepted boolean", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    )


def running_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows so far of each key; run it in update mode."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def write_handoff(rows: DataFrame, key: str, shards: int, path: str, checkpoint: str):
    """Start sending each row to its owner's folder (`owner=<shard>`); files appear whole, offsets are in the checkpoint."""
    sent = rows.withColumn("owner", shard_of(F.col(key), shards))
    return sent.writeStream.format("parquet").partitionBy("owner").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_handoff(spark: SparkSession, path: str, schema: str, owner: int, shards: int, key: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of rows sent to a shard; rows that it doesn't own are refused again."""
    inbox = spark.readStream.schema(f"{schema}, owner int").option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return inbox.where((F.col("owner") == owner) & (shard_of(F.col(key), shards) == owner)).drop("owner")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, timeout: int = 300) -> DataFrame:
    """What a finite stream leaves, as a table below the shared folder; a batch that is run again replaces what it wrote."""
    spark = stream.sparkSession
    folder = f"{_shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={i}")).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"stream {name} took more than {timeout} s")
    finally:
        query.stop()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/batches/batch=*")


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return (folder or "file:///tmp/checkpoints").rstrip("/") + "/sparkfrontier"
