"""Seed selection: ranked domains without infrastructure, one per registered domain, quotas by top-level domain, probe filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS
from sparkfrontier.functions.domains import slot_of_host, tld

# Substrings of names that serve assets, interfaces or name service, but no pages.
INFRASTRUCTURE = (
    "gstatic akamai googleapis amazonaws cloudfront fbcdn doubleclick googlesyndication googletagmanager google-analytics gvt1 gvt2 cloudflare-dns azureedge "
    "windowsupdate root-servers in-addr ntp.org llnwd edgekey edgesuite cdn77 fastly trafficmanager cloudapp elasticbeanstalk gtld-servers nstld -ns. ns1. ns2. "
    "dnsnode nic. domaincontrol googlevideo ytimg gvt0 cloudsink cdninstagram licdn twimg sharepoint office365 azure-dns awsdns"
).split()


def is_infrastructure(domain):
    return domain.rlike("|".join(m.replace(".", r"\.") for m in INFRASTRUCTURE))


def seed_lines(lines: DataFrame) -> DataFrame:
    """Seed URLs of (value) lines, without blank ones and comments."""
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("url"))


def one_per_registered(domains: DataFrame) -> DataFrame:
    """(domain, rank): the first name of each registered domain, infrastructure left out."""
    kept = domains.where(~is_infrastructure(F.col("domain")))
    return kept.groupBy(slot_of_host(F.col("domain")).alias("slot")).agg(F.min(F.struct("rank", "domain")).alias("x")).select("x.domain", "x.rank", "slot")


def select_seeds(domains: DataFrame, count: int, pool: int, max_share: float = 0.35) -> DataFrame:
    """(domain, rank, tld, position): `count` domains of the first `pool`, spread over top-level domains.

    Each has a quota by its share of the pool, one at least and max_share of the list at most; quotas are filled largest
    first, and what is missing is topped up one each per pass in that order, past the cap. Positions count from 1.
    """
    picked = one_per_registered(domains.where(F.col("rank") <= pool)).withColumn("tld", tld(F.col("domain")))
    sizes = picked.groupBy("tld").agg(F.count("*").alias("size"), F.min("rank").alias("best"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.desc("size"), "best")  # a row for each top-level domain
    cap = max(1, int(count * max_share))
    quota = F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(F.lit(count) * F.col("size") / F.sum("size").over(everything)).cast("long")))
    sizes = sizes.withColumn("place", F.row_number().over(order)).withColumn("quota", F.least(quota, F.col("size")))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_quota", F.sum("quota").over(everything))
    ranked = picked.withColumn("nth", F.row_number().over(Window.partitionBy("tld").orderBy("rank"))).join(F.broadcast(sizes.select("tld", "place", "quota", "before", "all_quota")), "tld")
    extra = ranked.where(F.col("nth") > F.col("quota")).withColumn("turn", F.col("nth") - F.col("quota"))
    topped = extra.orderBy("turn", "place").limit(count).withColumn("position", F.col("all_quota") + F.row_number().over(Window.orderBy("turn", "place")))
    base = ranked.where(F.col("nth") <= F.col("quota")).withColumn("position", F.col("before") + F.col("nth"))
    return base.select("domain", "rank", "tld", "position").unionByName(topped.select("domain", "rank", "tld", "position")).where(F.col("position") <= count)


def probed(results: DataFrame, count: int = 1000) -> DataFrame:
    """Of (url, rank, links) the first `count` by rank with enough links."""
    return results.where(F.col("links") >= DEFAULTS.min_links).orderBy("rank").limit(count)


def reject_notes(results: DataFrame, top: int = 6) -> DataFrame:
    return results.where(F.col("links") < DEFAULTS.min_links).groupBy("note").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "note").limit(top)
