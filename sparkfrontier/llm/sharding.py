"""Sharding by sampled splitters, law `bytes`: shards of near-equal size.

A size-weighted sample of keys (hash of the text, hash of the id) gives quantile boundaries; rows are range-partitioned
by them, and ranges that turn out overfull are subdivided by a second sample. A shard takes whole ranges; only the few
ranges that a shard's edge runs through are read once more, to cut them at the row where the edge falls.
Equal texts are neighbours in that order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, stage_out, table

#: A range holds about so many bytes; there are at least MIN_RANGES and at most MAX_RANGES, so that what the driver
#: holds (16 sampled keys of 24 bytes a range) is bounded.
RANGE_BYTES = 128 << 20
MIN_RANGES, MAX_RANGES, SAMPLES_PER_RANGE = 384, 1 << 17, 16
OVERFULL = 2.0


def _sortable(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Pairs of signed 64-bit keys as unsigned pairs, ordered like (k1, k2)."""
    out = np.empty(len(k1), dtype=[("a", "<i8"), ("b", "<i8")])
    out["a"], out["b"] = k1, k2
    return out


def _ranges(cuts: np.ndarray):
    first, second = cuts["a"].copy(), cuts["b"].copy()

    @F.pandas_udf("int")
    def range_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(), k2.to_numpy()
        lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        inside = np.flatnonzero(hi > lo)
        for i in inside:  # a cut within a group of equal texts: the id's hash decides
            lo[i] += np.searchsorted(second[lo[i] : hi[i]], b[i], "right")
        return pd.Series(lo.astype("int32"))

    return range_of


def _quantiles(k1, k2, weight, n: int) -> np.ndarray:
    keys = _sortable(np.asarray(k1, dtype="i8"), np.asarray(k2, dtype="i8"))
    order = np.lexsort((keys["b"], keys["a"]))
    at = np.cumsum(np.asarray(weight, dtype="f8")[order])
    return keys[order][np.searchsorted(at, at[-1] * np.arange(1, n) / n)] if len(at) else keys


def _cuts(work: DataFrame, total: int, n: int) -> tuple[np.ndarray, list]:
    """Splitters for about n even ranges, and (range, bytes, rows) of each range that has rows."""
    m = n * SAMPLES_PER_RANGE
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(m / total))
    sample = work.where(F.rand(7) < chance).select("k1", "k2", F.greatest(F.col("size").cast("double"), F.lit(total / m)).alias("w")).toPandas()
    cuts = np.unique(_quantiles(sample["k1"], sample["k2"], sample["w"], n))
    totals = lambda: work.groupBy(_ranges(cuts)("k1", "k2").alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    found = totals()
    over = {x["r"]: x["b"] for x in found if x["b"] > OVERFULL * total / n}
    if over:
        again = work.withColumn("r", _ranges(cuts)("k1", "k2")).where(F.col("r").isin(list(over)))
        sample = again.where(F.rand(8) < F.least(F.lit(1.0), F.col("size") * F.lit(4 * m / total))).select("r", "k1", "k2", F.greatest(F.col("size").cast("double"), F.lit(total / (4 * m))).alias("w")).toPandas()
        more = [_quantiles(x["k1"], x["k2"], x["w"], int(2 * over[r] * n / total) + 1) for r, x in sample.groupby("r")]
        cuts = np.unique(np.concatenate([cuts, *more]))
        found = totals()
    return cuts, sorted(found, key=lambda x: x["r"])


def shard_documents(docs: DataFrame, n_shards: int = 24, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (or its columns in `keep`) with shard_size, shard and shard_slot; one row per input row.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Rows are ordered by (hash of text, hash of id, id);
    shard k takes the k-th of n_shards equal shares of the bytes, so shards differ by about one row and equal texts share a shard
    unless a shard's edge runs through them. Slots count from 0 within a shard, in that order. Null ids and texts are hashed
    like values; rows equal in both may trade places, and are dealt like others, however many. A long text is one row and is
    never cut, so shards differ by the longest text at an edge at most. Input columns named like an added one are replaced. An empty table
    gives an empty result.
    """
    added = {"shard_size", "shard", "shard_slot"}
    kept = [c for c in only(docs, keep) if c.lower() not in added]
    size: Column = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    base = docs.select(packed(kept).alias("_"), size.alias("size"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2"), F.col(id_col).cast("string").alias("id"))
    if keep is not None:  # few narrow columns: read the texts once
        base = stage_out(base, "shard-rows")
    work = base.drop("_") if keep is not None else stage_out(base.drop("_"), "shard-rows")
    total = work.agg(F.sum("size")).first()[0]
    if not total:  # an empty table, as every row has a size
        return base.select(*[f"_.`{c}`" for c in kept], F.col("size").alias("shard_size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_slot"))
    cuts, found = _cuts(work, total, max(MIN_RANGES, min(MAX_RANGES, -(-total // RANGE_BYTES))))
    before_b, before_n = np.zeros(len(cuts) + 1, "i8"), np.zeros(len(cuts) + 1, "i8")
    for x in found:
        before_b[x["r"]], before_n[x["r"]] = x["b"], x["n"]
    ends = np.cumsum(before_b)
    before_b, before_n = ends - before_b, np.cumsum(before_n) - before_n
    rows_before = F.pandas_udf(lambda r: pd.Series(before_n[r]), "long")
    edges = _edges(work.withColumn("r", _ranges(cuts)("k1", "k2")), total, n_shards, ends, before_b, before_n)
    here = Window.partitionBy("r").orderBy("k1", "k2", "id")
    place = (rows_before("r") + F.row_number().over(here) - 1).alias("place")
    rows = base.withColumn("r", _ranges(cuts)("k1", "k2")).select("_", "size", place)
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:]]).cast("array<bigint>"), lambda e: e <= F.col("place")))
    start = F.element_at(F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), F.col("shard") + 1)
    return rows.withColumn("shard", shard).select(*[f"_.`{c}`" for c in kept], F.col("size").alias("shard_size"), "shard", (F.col("place") - start).alias("shard_slot"))


def _edges(ranged: DataFrame, total: int, n_shards: int, ends: np.ndarray, before_b: np.ndarray, before_n: np.ndarray) -> list[int]:
    """The places of the shards' first rows. An edge lies in the range where the bytes reach the shard's share; only those ranges are cut at a row."""
    goals = [total * k / n_shards for k in range(1, n_shards)]
    inside = [int(np.searchsorted(ends, g, "right")) for g in goals]
    here = Window.partitionBy("r").orderBy("k1", "k2", "id")
    cut = ranged.where(F.col("r").isin(sorted(set(inside)))).select("r", "size", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("b"), F.row_number().over(here).alias("n"))
    # a row belongs to the shard that its middle lies in, so an edge stands behind the rows whose middle is below its goal
    passed = [F.sum(F.when((F.col("r") == r) & (F.col("b") - F.col("size") / 2 < g - float(before_b[r])), 1).otherwise(0)).alias(f"e{i}") for i, (r, g) in enumerate(zip(inside, goals, strict=True))]
    found = cut.agg(*passed).first() if goals else ()
    return [0, *[int(before_n[r]) + int(n or 0) for r, n in zip(inside, found, strict=True)]]


def op2_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = shard_documents(docs, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
