"""Registered domains and shards of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.functions.urls import host

# Public suffixes of two and more labels, private ones included. A host under any other name is keyed by its
# last two labels. This list is a small part of the public one.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn "
    "co.jp ne.jp or.jp ac.jp go.jp com.tw org.tw net.tw gov.tw co.kr or.kr go.kr co.in net.in org.in gov.in ac.in com.mx org.mx gob.mx com.ar com.tr gov.tr org.tr "
    "co.za org.za gov.za com.sg com.hk com.my co.nz org.nz govt.nz com.ua co.il org.il com.pl net.pl org.pl com.ru msk.ru spb.ru com.vn com.ph co.id or.id go.id com.co com.pe com.eg com.sa "
    "blogspot.com github.io gitlab.io herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com wordpress.com appspot.com azurewebsites.net cloudfront.net s3.amazonaws.com"
).split()
_SUFFIX = "(" + "|".join(s.replace(".", r"\.") for s in sorted(SUFFIXES, key=len, reverse=True)) + ")"
_IP = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|:"


def slot_of_host(h: Column) -> Column:
    """The registered domain of a host; an address or a single label is its own, an empty host is __nohost__."""
    listed = F.regexp_extract(h, rf"([^.]+\.{_SUFFIX})\.?$", 1)
    bare = h.rlike(rf"^{_SUFFIX}$")
    return F.when(h == "", "__nohost__").when(h.rlike(_IP) | bare, h).when(listed != "", listed).when(h.rlike(r"[^.]\.[^.]+$"), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)).otherwise(h)


def registered(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """hosts with slot by the public suffix rules (rule): the longest suffix and one label more.

    Rules are plain names, `*.name` for any label in front of it, and `!name` for an exception. An exception wins; a host
    under no rule, or one that is a suffix itself, is its own slot, and so is an address; null and empty are __nohost__.
    Each different host is looked up once.
    """
    h = F.lower(F.coalesce(F.col(host_col), F.lit("")))
    names = hosts.select(h.alias("name")).distinct().where((F.col("name") != "") & ~F.col("name").rlike(_IP))
    names = names.withColumn("labels", F.split(F.regexp_replace("name", r"\.$", ""), r"\.")).withColumn("n", F.size("labels"))
    tail = lambda k: F.array_join(F.slice("labels", F.col("n") - k + 1, k), ".")
    each = names.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    tried = F.array(
        F.struct(tail(F.col("k")).alias("rule"), F.col("k").alias("public"), F.lit(0).alias("wins")),
        F.struct(F.concat(F.lit("*."), tail(F.col("k"))).alias("rule"), (F.col("k") + 1).alias("public"), F.lit(0).alias("wins")),
        F.struct(F.concat(F.lit("!"), tail(F.col("k"))).alias("rule"), (F.col("k") - 1).alias("public"), F.lit(1).alias("wins")),
    )
    found = each.select("name", "labels", "n", F.explode(tried).alias("x")).select("name", "labels", "n", "x.*").join(rules.select("rule").distinct(), "rule")
    best = found.groupBy("name", "labels", "n").agg(F.max(F.struct("wins", "public"))["public"].alias("public")).where("n > public")
    best = best.select("name", tail(F.col("public") + 1).alias("slot"))
    return hosts.drop("slot").withColumn("name", h).join(best, "name", "left").withColumn("slot", F.coalesce("slot", F.when(F.col("name") == "", "__nohost__").otherwise(F.col("name")))).drop("name")


def slot_key(url: Column) -> Column:
    return slot_of_host(host(url))


def shard_of(key: Column, shards: int) -> Column:
    """The first eight bytes of the key's MD5, unsigned, modulo the shard count."""
    return (F.conv(F.substring(F.md5(key), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("int")


def tld(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)
