"""The frontier: fingerprints and first sights, caps per domain, admission, wave order, limiter schedule, shards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS
from sparkfrontier.functions.domains import shard_of, slot_key
from sparkfrontier.functions.urls import fingerprint
from sparkfrontier.operators.running import Cuts, numbered


def first_seen(rows: DataFrame, url: str, seq: str) -> DataFrame:
    """One row for each URL fingerprint: the first by seq. A map-side minimum, so frequent URLs don't gather in a task."""
    others = [c for c in rows.columns if c not in (url, seq)]
    return rows.groupBy(fingerprint(F.col(url)).alias("fp")).agg(F.min(F.struct(seq, url, *others)).alias("x")).select("fp", "x.*")


def unseen(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose fingerprint isn't in seen (fp)."""
    return candidates.withColumn("fp", fingerprint(F.col(url))).join(seen.select("fp"), "fp", "left_anti")


def capped(rows: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """The first `cap` rows of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where(F.col("nth") <= cap)


def capped_after(rows: DataFrame, counts: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """The first rows of each key that its stored counter (key, count) leaves room for; a key without a counter starts at 0.

    Only `cap` rows of a key can pass, so the others go before counters are joined.
    """
    first = capped(rows, key, seq, cap)
    return first.join(counts.select(key, F.col("count").alias("_stored")), key, "left").withColumn("nth", F.col("nth") + F.coalesce("_stored", F.lit(0))).drop("_stored").where(F.col("nth") <= cap)


def counters_after(counts: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Stored counters with the rows that were let through added."""
    return counts.select(key, "count").unionByName(kept.groupBy(key).agg(F.count("*").alias("count"))).groupBy(key).agg(F.sum("count").alias("count"))


def queue_depth(changes: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Per key the deepest its queue was and how deep it ends, from +1 and -1 rows in order."""
    depth = F.sum(delta).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return changes.withColumn("depth", depth).groupBy(key).agg(F.max("depth").alias("deepest"), F.sum(delta).alias("left"))


def wave_order(rows: DataFrame, slot: str = "slot", seq: str = "seq") -> DataFrame:
    """rows with round and position: round-robin over slots in order of their first row, first in first out within a slot."""
    by_slot = Window.partitionBy(slot)
    rows = rows.withColumn("round", F.row_number().over(by_slot.orderBy(seq))).withColumn("first_seq", F.min(seq).over(by_slot))
    return numbered(rows, "round", ["first_seq"]).withColumnRenamed("row_index", "position").drop("first_seq")


def admission(rows: DataFrame, queues: int = DEFAULTS.max_queues, cap: int = DEFAULTS.max_frontier, exempt_factor: float = DEFAULTS.exempt_factor) -> DataFrame:
    """(slot, seq) rows with new_domain and verdict while nothing is taken out: admitted, over_queues or over_capacity.

    A slot without a queue is refused once `queues` slots have one. Then the size counts: below cap all rows pass, from cap
    up to cap * exempt_factor only a slot's first row. All running counts are over ranges of seq, not over one task.
    """
    ceiling = int(cap * exempt_factor)
    firsts = numbered(rows.groupBy("slot").agg(F.min("seq").alias("first_seq")), "first_seq", []).withColumnRenamed("row_index", "slot_rank")
    rows = rows.join(firsts, "slot").withColumn("new_domain", F.col("seq") == F.col("first_seq"))
    open_slot = F.col("slot_rank") <= queues
    cuts = Cuts(rows, ["seq"])
    rows = numbered(rows, "seq", [], {"eligible": open_slot.cast("long")}, cuts=cuts).drop("row_index")
    rows = rows.withColumn("full", F.col("eligible") > cap)
    rows = numbered(rows, "seq", [], cuts=cuts, sums={"exempted": (open_slot & F.col("full") & F.col("new_domain")).cast("long"), "opened": (open_slot & F.col("new_domain") & ~F.col("full")).cast("long")}).drop("row_index")
    exempt = F.col("new_domain") & (F.col("exempted") <= ceiling - cap)
    live = F.col("opened") + F.least(F.col("exempted"), F.lit(ceiling - cap))
    verdict = F.when(~open_slot & (live >= queues), "over_queues").when(open_slot & (~F.col("full") | exempt), "admitted").when(~open_slot & ~F.col("full"), "over_queues").otherwise("over_capacity")
    return rows.select("slot", "seq", "new_domain", verdict.alias("verdict"))


_REPLAYED = "shard int, slot string, seq long, verdict string"


def admission_replay(events: DataFrame, queues: int = DEFAULTS.max_queues, cap: int = DEFAULTS.max_frontier, exempt_factor: float = DEFAULTS.exempt_factor) -> DataFrame:
    """(shard, seq, slot, kind) events, kind `put` or `take` -> puts with their verdict, while rows are taken out as well.

    A drained queue frees its place, and a take without a queue does nothing. Limits are of a shard, and so is the state: its
    events are one sequence by nature, streamed through one task that holds `queues` counters and the slots seen.
    """
    ceiling = int(cap * exempt_factor)

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, live, seen, size = None, Counter(), set(), 0
        for frame in frames:
            out = []
            for s, seq, slot, kind in zip(frame["shard"], frame["seq"], frame["slot"], frame["kind"], strict=True):
                if s != shard:
                    shard, live, seen, size = s, Counter(), set(), 0
                if kind == "take":
                    if live[slot]:
                        live[slot] -= 1
                        size -= 1
                    if not live[slot]:
                        del live[slot]
                    continue
                fresh = slot not in seen
                seen.add(slot)
                if slot not in live and len(live) >= queues:
                    verdict = "over_queues"
                elif size >= cap and not (fresh and size < ceiling):
                    verdict = "over_capacity"
                else:
                    verdict = "admitted"
                    live[slot] += 1
                    size += 1
                out.append((s, slot, seq, verdict))
            yield pd.DataFrame(out, columns=["shard", "slot", "seq", "verdict"])

    return events.select(F.col("shard").cast("int").alias("shard"), "seq", F.col("slot").cast("string").alias("slot"), "kind").repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(replay, _REPLAYED)


def limiter_schedule(rows: DataFrame, delay: float = DEFAULTS.download_delay, completed: DataFrame | None = None, delays: DataFrame | None = None) -> DataFrame:
    """(slot, seq, arrive, rtt) with start: start_k = max(arrive_k, end of k-1 + delay), in closed form.

    With S_k the service time in front of k, start_k = S_k + max over j <= k of (arrive_j - S_j). completed (slot,
    last_complete) is the history kept from before: a slot's first request waits for it too. delays (slot, crawl_delay), as
    robots.effective_delay caps them, hold where they are longer than delay. Both have a row a slot at most.
    """
    if delays is not None:
        rows = rows.join(delays.select("slot", F.col("crawl_delay").cast("double").alias("crawl_delay")), "slot", "left")
    if completed is not None:
        rows = rows.join(completed.select("slot", "last_complete"), "slot", "left")
    pause = F.greatest(F.lit(delay), F.col("crawl_delay")) if delays is not None else F.lit(delay)  # greatest skips null
    order = Window.partitionBy("slot").orderBy("arrive", "seq")
    service = F.coalesce(F.sum(F.col("rtt") + pause).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("service", service)
    slack = F.max(F.col("arrive") - F.col("service")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if completed is not None:
        slack = F.greatest(slack, F.col("last_complete") + pause)
    return rows.withColumn("start", F.col("service") + slack).withColumn("waited", F.col("start") - F.col("arrive")).drop("service", "crawl_delay", "last_complete")


def shard_load(keys: DataFrame, key: str, shards: int) -> DataFrame:
    """shard, keys; every shard has a row."""
    load = keys.select(key).distinct().groupBy(shard_of(F.col(key), shards).alias("shard")).agg(F.count("*").alias("keys"))
    return keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").select("shard", F.coalesce("keys", F.lit(0)).alias("keys"))


def owned(rows: DataFrame, key: Column, shard: int, shards: int) -> DataFrame:
    return rows.where(shard_of(key, shards) == shard)


def idle_first(slots: DataFrame, n: int = 1) -> DataFrame:
    """The slots to serve next: idle ones first, by their place in the ring, then the least active."""
    return slots.orderBy(F.col("active").asc(), F.col("ring").asc()).limit(n)


def reroute(redirects: DataFrame, seen: DataFrame, shards: int, target: str = "target", sender: str = "sender") -> DataFrame:
    """Redirect targets as new candidates: those not seen, each once, with the shard that owns them and whether that is another one."""
    fresh = unseen(redirects, seen, target)
    first = fresh.groupBy("fp").agg(F.min(F.struct(target, sender)).alias("x")).select(f"x.{target}", f"x.{sender}")
    return first.withColumn("owner", shard_of(slot_key(F.col(target)), shards)).withColumn("handed_off", F.col("owner") != F.col(sender))
