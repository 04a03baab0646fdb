"""Reports on crawl logs: totals, latencies, timelines, growth curves and projections."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS
from sparkfrontier.operators.running import numbered


def crawl_metrics(rows: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """One row of totals, rates and naive projections; rows without a sent stamp are counted apart.

    discovered (url) adds how many different links were found, how many that is per page, and their projection.
    """
    out = rows.agg(
        F.count("*").alias("crawled"), F.count_if(F.col("status").startswith("2")).alias("ok"), F.sum("n_links").alias("links"), F.sum("bytes").alias("bytes"),
        F.count_if(F.col("sent_ts").isNull()).alias("missing_stamp"), F.count_distinct("slot_id").alias("domains"),
        F.greatest(F.max("recv_ts") - F.min("sent_ts"), F.lit(1e-6)).alias("elapsed"),
    )
    out = out.withColumns({"pages_per_s": F.col("crawled") / F.col("elapsed"), "links_per_page": F.col("links") / F.col("crawled")})
    out = out.withColumn("projected", F.col("pages_per_s") * DEFAULTS.projection_seconds)
    if discovered is None:
        return out
    new = discovered.agg(F.count_distinct("url")).scalar()
    out = out.withColumn("discovered_unique", new).withColumn("new_per_page", F.col("discovered_unique") / F.col("crawled"))
    return out.withColumn("projected_links", F.col("projected") * F.col("new_per_page"))


def parseable(rows: DataFrame) -> DataFrame:
    """The rows whose response reaches the parser: status 2xx. A null status does not."""
    return rows.where(F.col("status").startswith("2"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def bucket_ends(samples: DataFrame, bucket: float) -> DataFrame:
    """Per shard and time bucket the last sample, and its difference to the bucket before as rates."""
    ends = samples.groupBy("shard", F.floor(F.col("elapsed") / bucket).cast("long").alias("bucket")).agg(F.max_by(F.struct("elapsed", "crawled", "discovered"), "seq").alias("x")).select("shard", "bucket", "x.*")
    before = Window.partitionBy("shard").orderBy("bucket")
    back = lambda c: F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))
    span = F.greatest(back("elapsed"), F.lit(1.0))
    return ends.select("shard", "bucket", "elapsed", "crawled", "discovered", (back("crawled") / span).alias("pages_per_s"), (back("discovered") / span).alias("links_per_s"))


def combined_total(ends: DataFrame) -> DataFrame:
    """Each shard's highest count, summed."""
    return ends.groupBy("shard").agg(F.max("crawled").alias("crawled")).agg(F.count("*").alias("shards"), F.sum("crawled").alias("combined"))


def domain_curve(stamps: DataFrame, marks: int = 40) -> DataFrame:
    """(i, t, domains): different keys of (t, key) rows seen at equal time marks; a row passes one mark at most, and the end is a point of its own.

    Counts of rows before each mark give the row that passes it; keys are then placed by their first row.
    """
    spark = stamps.sparkSession
    ends = stamps.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).first()
    schema = "i int, t double, domains long"
    if not ends["n"] or ends["hi"] <= ends["lo"]:
        return spark.createDataFrame([], schema)
    lo, span = ends["lo"], ends["hi"] - ends["lo"]
    step, at = span / marks, []
    for k in range(marks + 1):
        at.append((at[-1] if k else 0.0) + step)
    reached = lambda c: F.size(F.filter(F.array(*map(F.lit, at)), lambda m: c - lo >= m))
    by_mark = {x["m"]: x["n"] for x in stamps.groupBy(reached(F.col("t")).alias("m")).agg(F.count("*").alias("n")).collect()}
    passing, before, last = [], 0, 0
    for k in range(marks + 1):  # row that passes mark k: the first at or after it, and after the row of the mark before
        before += by_mark.get(k, 0)
        last = max(before + 1, last + 1)
        if last > ends["n"]:
            break
        passing.append(last)
    rows = numbered(stamps, "t", ["key"]).where(F.col("row_index").isin(passing)).select("row_index", "t", "key").orderBy("row_index").collect()
    firsts = stamps.groupBy("key").agg(F.min("t").alias("t"))
    point = lambda r: F.struct(F.lit(r["t"]).alias("t"), F.lit(r["key"]).alias("key"))
    later = F.size(F.filter(F.array(*[point(r) for r in rows]), lambda p: p < F.struct(F.col("t").alias("t"), F.col("key").alias("key")))) if rows else F.lit(0)
    placed = {x["m"]: x["n"] for x in firsts.groupBy(later.alias("m")).agg(F.count("*").alias("n")).collect()}
    out, seen = [], 0
    for k in range(len(rows)):
        seen += placed.get(k, 0)
        out.append((k, at[k], seen))
    return spark.createDataFrame([*out, (len(rows), span, sum(placed.values()))], schema)


def through_origin(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope of the least-squares line through the origin, and its R² against the mean (which may be negative)."""
    k = F.sum(x * y) / F.sum(x * x)
    left = F.sum(y * y) - 2 * k * F.sum(x * y) + k * k * F.sum(x * x)
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    return F.coalesce(k, F.lit(0.0)), F.when(total > 0, 1 - left / total).otherwise(0.0)


def growth_fit(points: DataFrame, t: str = "t", v: str = "domains") -> DataFrame:
    """One row: linear and square-root fits, rates of the first and last third, peak, verdict and projection. points has a column i from 0."""
    y = F.col(v).cast("double")
    lin_k, lin_r2 = through_origin(F.col(t), y)
    root_k, root_r2 = through_origin(F.sqrt(t), y)
    n = points.count()
    third = n // 3
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    rate = lambda a, b: F.when(at(t, b) - at(t, a) > 0, (at(v, b) - at(v, a)) / (at(t, b) - at(t, a)))
    out = points.agg(F.max(v).alias("peak"), lin_k.alias("linear_k"), lin_r2.alias("linear_r2"), root_k.alias("root_k"), root_r2.alias("root_r2"), rate(0, third).alias("early"), rate(n - third - 1, n - 1).alias("late"))
    horizon = float(DEFAULTS.projection_seconds)
    better = F.when(F.col("linear_r2") >= F.col("root_r2"), "linear").otherwise("root")
    verdict = F.when(F.col("late") <= 0, "turned over").when(F.greatest("linear_r2", "root_r2") < 0.5, "unreliable").otherwise(better)
    projected = F.when(F.col("late") <= 0, F.lit(None)).when(F.col("linear_r2") >= F.col("root_r2"), F.col("linear_k") * horizon).otherwise(F.col("root_k") * sqrt(horizon))
    return out.withColumn("verdict", verdict).withColumn("projected", projected).withColumn("slowdown", F.when(F.col("early") > 0, F.col("late") / F.col("early")))
