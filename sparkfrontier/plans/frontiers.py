"""Queries: frontier, shards, admission, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfrontier.functions.domains import shard_of
from sparkfrontier.functions.urls import fingerprint, hash128, without_fragment
from sparkfrontier.operators import audit, frontier
from sparkfrontier.sources import relations as r


def _urls(spark, sf_dir):
    return r.table(spark, sf_dir, "pages").select("page_id", without_fragment(F.col("url")).alias("url"))


def url_fingerprint(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", fingerprint(F.col("url")).alias("fp"))


def dedup_first_seen(spark, sf_dir):
    return frontier.first_seen(_urls(spark, sf_dir), "url", "page_id").select("page_id", "url")


def dedup_anti_join(spark, sf_dir):
    urls = _urls(spark, sf_dir)
    seen = urls.where("page_id % 3 = 0").select(fingerprint(F.col("url")).alias("fp"))
    return frontier.unseen(urls, seen).select("page_id", "url")


def per_domain_cap(spark, sf_dir):
    return frontier.capped(r.arrivals(spark, sf_dir), "slot", "seq", 20).groupBy("slot").agg(F.count("*").alias("kept"), F.max("seq").alias("last_seq"))


def url_hash128(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", F.lower(F.hex(hash128(F.col("url")))).alias("key"))


def per_domain_cap_resumed(spark, sf_dir):
    """The cap of 20 when every third slot has a stored counter."""
    a = r.arrivals(spark, sf_dir)
    stored = a.select("slot").distinct().where("slot % 3 = 0").select("slot", F.pmod("slot", F.lit(25)).cast("long").alias("count"))
    kept = frontier.capped_after(a, stored, "slot", "seq", 20)
    return frontier.counters_after(stored, kept, "slot").select("slot", F.col("count").cast("long").alias("n"))


def admission_replay(spark, sf_dir):
    """Arrivals put and, some time later, taken, in four shards with small limits."""
    a = r.arrivals(spark, sf_dir)
    shard = F.pmod("slot", F.lit(4)).cast("int").alias("shard")
    puts = a.select(shard, "slot", F.col("seq").alias("at"), F.lit("put").alias("kind"))
    takes = a.where("seq % 3 <> 0").select(shard, "slot", (F.col("seq") + 40).alias("at"), F.lit("take").alias("kind"))
    events = puts.unionByName(takes).select("shard", "slot", (F.col("at") * 2 + (F.col("kind") == "take").cast("long")).alias("seq"), "kind")
    return frontier.admission_replay(events, queues=4, cap=30).groupBy("shard", "verdict").agg(F.count("*").alias("n"))


def queue_depth(spark, sf_dir):
    a = r.arrivals(spark, sf_dir)
    changes = a.select("slot", F.col("arrive").alias("t"), F.lit(1).alias("delta"), "seq").unionByName(a.select("slot", (F.col("arrive") + F.col("rtt") * 50).alias("t"), F.lit(-1).alias("delta"), "seq"))
    return frontier.queue_depth(changes, "slot", ["t", "seq", "delta"], "delta").select("slot", F.col("deepest").cast("long").alias("deepest"), F.col("left").cast("long").alias("left"))


def wave_order(spark, sf_dir):
    return frontier.wave_order(r.arrivals(spark, sf_dir)).select("slot", "seq", F.col("round").cast("long").alias("round"), F.col("position").cast("long").alias("position"))


def admission_caps(spark, sf_dir):
    return frontier.admission(r.arrivals(spark, sf_dir), queues=12, cap=300).groupBy("verdict").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def limiter_schedule(spark, sf_dir):
    return frontier.limiter_schedule(r.arrivals(spark, sf_dir), 1800.0).select("slot", "seq", F.round("start", 3).alias("start"), F.round("waited", 3).alias("waited"))


def limiter_resumed(spark, sf_dir):
    """The schedule after a restart: every third slot has a history, every fourth a crawl delay of its own."""
    a = r.arrivals(spark, sf_dir)
    completed = a.where("slot % 3 = 0").groupBy("slot").agg((F.min("arrive") + 10000.0).alias("last_complete"))
    delays = a.select("slot").distinct().where("slot % 4 = 0").select("slot", F.when(F.col("slot") % 8 == 0, 3600.0).otherwise(60.0).alias("crawl_delay"))
    out = frontier.limiter_schedule(a, 1800.0, completed, delays)
    return out.select("slot", "seq", F.round("start", 3).alias("start"), F.round("waited", 3).alias("waited"))


def shard_assignment(spark, sf_dir):
    return r.table(spark, sf_dir, "customer").select("c_custkey", shard_of(F.col("c_name"), 8).alias("shard"))


def shard_balance(spark, sf_dir):
    load = frontier.shard_load(r.table(spark, sf_dir, "customer"), "c_name", 8)
    return load.agg(F.min("keys").alias("least"), F.max("keys").alias("most"), F.round(F.max("keys") / F.greatest(F.min("keys"), F.lit(1)), 6).alias("ratio"))


def handoff_counts(spark, sf_dir):
    """Links found by the shard of their page and the shard that owns them."""
    pages = r.table(spark, sf_dir, "pages")
    urls = pages.select(shard_of(F.col("page_id").cast("string"), 4).alias("sender"), shard_of(F.col("url"), 4).alias("owner"))
    return urls.groupBy("sender", "owner").agg(F.count("*").alias("urls")).withColumn("foreign", F.col("sender") != F.col("owner"))


def idle_slots(spark, sf_dir):
    slots = r.arrivals(spark, sf_dir).groupBy("slot").agg(F.min("seq").alias("ring"), F.pmod(F.count("*"), F.lit(7)).alias("active"))
    return frontier.idle_first(slots, 10).select("slot", "ring", "active")


def redirect_reroute(spark, sf_dir):
    """Pages that redirect to the host's root on another scheme, against the page URLs as seen."""
    plain = without_fragment(F.col("url"))
    pages = r.table(spark, sf_dir, "pages").select("page_id", plain.alias("url"))
    target = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^(https?://[^/?#]+).*$", "$1/moved"))
    redirects = pages.select(target.alias("target"), (F.col("page_id") % 3).cast("int").alias("sender"))
    return frontier.reroute(redirects, pages.select(fingerprint(F.col("url")).alias("fp")), 3)


def exit_codes(spark, sf_dir):
    """The audit's exit code for a floor that holds, one that doesn't, and no input."""
    rows = r.dispatched(spark, sf_dir)
    runs = [("holds", audit.politeness_verdict(rows, 0.001)), ("broken", audit.politeness_verdict(rows, 3600.0)), ("empty", audit.politeness_verdict(rows.limit(0), 5.0))]
    out = [audit.exit_code(v).select(F.lit(name).alias("run"), "requests", "code") for name, v in runs]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {f.__name__: f for f in (url_fingerprint, dedup_first_seen, dedup_anti_join, url_hash128, per_domain_cap, per_domain_cap_resumed, admission_replay, queue_depth, wave_order, admission_caps, limiter_schedule, limiter_resumed, shard_assignment, shard_balance, handoff_counts, idle_slots, redirect_reroute, exit_codes)}

_U = "u AS (SELECT page_id, split_part(url, '#', 1) AS url FROM pages)"
_FP = """sha1('{"body": "", "headers": {}, "method": "GET", "url": "' || url || '"}')"""
_A = "a AS (SELECT user_id AS slot, event_id AS seq, epoch_us(ts) / 1000000.0 AS arrive, value AS rtt FROM events)"
_SHARD = "(('0x' || substr(md5({0}), 1, 16))::UBIGINT % {1})::INT"
ORACLE_SQL = {
    "url_fingerprint": f"WITH {_U} SELECT page_id, {_FP} AS fp FROM u",
    "dedup_first_seen": f"WITH {_U} SELECT min(page_id) AS page_id, url FROM u GROUP BY url",
    "dedup_anti_join": f"WITH {_U} SELECT page_id, url FROM u WHERE url NOT IN (SELECT url FROM u WHERE page_id % 3 = 0)",
    "per_domain_cap": f"WITH {_A} SELECT slot, count(*) AS kept, max(seq) AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY seq) AS n FROM a) WHERE n <= 20 GROUP BY slot",
    "url_hash128": f"WITH {_U} SELECT page_id, substr({_FP}, 1, 32) AS key FROM u",
    "per_domain_cap_resumed": f"""WITH {_A}, s AS (SELECT DISTINCT slot, (slot % 25)::BIGINT AS c FROM a WHERE slot % 3 = 0), k AS (SELECT slot, count(*) AS n FROM a GROUP BY slot)
SELECT slot, (coalesce(c, 0) + least(n, greatest(20 - coalesce(c, 0), 0)))::BIGINT AS n FROM k LEFT JOIN s USING (slot)""",
    "queue_depth": f"""WITH {_A}, c AS (SELECT slot, arrive AS t, 1 AS delta, seq FROM a UNION ALL SELECT slot, arrive + rtt * 50, -1, seq FROM a),
d AS (SELECT slot, delta, sum(delta) OVER (PARTITION BY slot ORDER BY t, seq, delta ROWS UNBOUNDED PRECEDING) AS depth FROM c)
SELECT slot, max(depth)::BIGINT AS deepest, sum(delta)::BIGINT AS left FROM d GROUP BY slot""",
    "wave_order": f"""WITH {_A}, b AS (SELECT slot, seq, row_number() OVER (PARTITION BY slot ORDER BY seq) AS round, min(seq) OVER (PARTITION BY slot) AS f FROM a)
SELECT slot, seq, round, row_number() OVER (ORDER BY round, f) AS position FROM b""",
    "admission_caps": f"""WITH {_A}, f AS (SELECT slot, min(seq) AS f, row_number() OVER (ORDER BY min(seq)) AS rk FROM a GROUP BY slot),
b AS (SELECT a.slot, seq, seq = f AS fresh, rk, sum(CASE WHEN rk <= 12 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS el FROM a JOIN f USING (slot)),
c AS (SELECT *, sum(CASE WHEN rk <= 12 AND fresh AND el > 300 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS ex, sum(CASE WHEN rk <= 12 AND fresh AND el <= 300 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS op FROM b),
v AS (SELECT seq, CASE WHEN rk > 12 AND (op + least(ex, 30) >= 12 OR el <= 300) THEN 'over_queues' WHEN rk <= 12 AND (el <= 300 OR fresh AND ex <= 30) THEN 'admitted' ELSE 'over_capacity' END AS verdict FROM c)
SELECT verdict, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM v GROUP BY 1""",
    "limiter_schedule": f"""WITH {_A}, s AS (SELECT *, coalesce(sum(rtt + 1800) OVER (PARTITION BY slot ORDER BY arrive, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sv FROM a),
t AS (SELECT slot, seq, arrive, sv + max(arrive - sv) OVER (PARTITION BY slot ORDER BY arrive, seq ROWS UNBOUNDED PRECEDING) AS start FROM s)
SELECT slot, seq, round(start, 3) AS start, round(start - arrive, 3) AS waited FROM t""",
    "limiter_resumed": f"""WITH {_A}, p AS (SELECT *, CASE WHEN slot % 8 = 0 THEN 3600 ELSE 1800 END AS pause, CASE WHEN slot % 3 = 0 THEN min(arrive) OVER (PARTITION BY slot) + 10000 END AS last FROM a),
s AS (SELECT *, coalesce(sum(rtt + pause) OVER (PARTITION BY slot ORDER BY arrive, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sv FROM p),
t AS (SELECT slot, seq, arrive, sv + greatest(max(arrive - sv) OVER (PARTITION BY slot ORDER BY arrive, seq ROWS UNBOUNDED PRECEDING), coalesce(last + pause, 0)) AS start FROM s)
SELECT slot, seq, round(start, 3) AS start, round(start - arrive, 3) AS waited FROM t""",
    "shard_assignment": f"SELECT c_custkey, {_SHARD.format('c_name', 8)} AS shard FROM customer",
    "shard_balance": f"""WITH l AS (SELECT {_SHARD.format('c_name', 8)} AS shard, count(DISTINCT c_name) AS n FROM customer GROUP BY 1), k AS (SELECT coalesce(n, 0) AS n FROM range(8) r(i) LEFT JOIN l ON l.shard = r.i)
SELECT min(n) AS least, max(n) AS most, round(max(n) / greatest(min(n), 1), 6) AS ratio FROM k""",
    "handoff_counts": f"SELECT {_SHARD.format('page_id::VARCHAR', 4)} AS sender, {_SHARD.format('url', 4)} AS owner, count(*) AS urls, {_SHARD.format('page_id::VARCHAR', 4)} <> {_SHARD.format('url', 4)} AS \"foreign\" FROM pages GROUP BY 1, 2, 4",
    "redirect_reroute": f"""WITH {_U}, t AS (SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^(https?://[^/?#]+).*$', '\\1/moved') END AS target, (page_id % 3)::INT AS sender FROM u),
f AS (SELECT target, min(sender) AS sender FROM t WHERE target NOT IN (SELECT url FROM u) GROUP BY target),
o AS (SELECT target, sender, {_SHARD.format("regexp_extract(target, '([^./]+[.][^./]+)/moved$', 1)", 3)} AS owner FROM f)
SELECT target, sender, owner, owner <> sender AS handed_off FROM o""",
    "exit_codes": """SELECT * FROM (VALUES ('holds', (SELECT count(*) FROM events), 0), ('broken', (SELECT count(*) FROM events), 1), ('empty', 0, 2)) v(run, requests, code)""",
    "idle_slots": f"WITH {_A} SELECT slot, min(seq) AS ring, count(*) % 7 AS active FROM a GROUP BY slot ORDER BY active, ring LIMIT 10",
}
