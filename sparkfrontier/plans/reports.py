"""Queries: metrics, timelines, growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfrontier.functions.domains import slot_key
from sparkfrontier.functions.links import page_hrefs
from sparkfrontier.operators import report
from sparkfrontier.operators.running import upper_indexes
from sparkfrontier.sources import relations as r
from sparkfrontier.sources.logs import crawled_lines, parse_crawled

BUCKET = 86_400.0


def crawl_metrics(spark, sf_dir):
    found = page_hrefs(r.table(spark, sf_dir, "pages")).select(F.col("href").alias("url"))
    out = report.crawl_metrics(r.crawled(spark, sf_dir), found)
    rates = [F.round(c, 6).alias(c) for c in ("elapsed", "pages_per_s", "links_per_page", "new_per_page")]
    return out.select("crawled", "ok", "links", "bytes", "missing_stamp", "domains", "discovered_unique", *rates, *[F.round(c, 3).alias(c) for c in ("projected", "projected_links")])


def status_counts(spark, sf_dir):
    return report.status_counts(r.crawled(spark, sf_dir))


def latency_p50_p90(spark, sf_dir):
    late = r.crawled(spark, sf_dir).select((F.col("recv_ts") - F.col("sent_ts")).alias("late"))
    return spark.createDataFrame([tuple(upper_indexes(late, "late", [0.5, 0.9]))], "p50 double, p90 double").select(F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


def unique_ok(spark, sf_dir):
    return report.parseable(r.crawled(spark, sf_dir)).agg(F.count_distinct("url").alias("unique_ok"), F.count("*").alias("rows_ok"))


def discovered_unique(spark, sf_dir):
    return page_hrefs(r.table(spark, sf_dir, "pages")).agg(F.count("*").alias("discovered"), F.count_distinct("href").alias("discovered_unique"))


def approx_domains(spark, sf_dir):
    return r.dispatched(spark, sf_dir).agg(F.approx_count_distinct("slot_id", 0.02).alias("approx_domains"))


def timeline_buckets(spark, sf_dir):
    ends = report.bucket_ends(r.runstats(spark, sf_dir), BUCKET)
    return ends.select("shard", "bucket", "crawled", "discovered", *[F.round(c, 6).alias(c) for c in ("elapsed", "pages_per_s", "links_per_s")])


def timeline_combined(spark, sf_dir):
    return report.combined_total(report.bucket_ends(r.runstats(spark, sf_dir), BUCKET))


def _curve(spark, sf_dir):
    return report.domain_curve(r.events(spark, sf_dir).select("t", F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string"), F.lit("."), F.col("user_id").cast("string")).alias("key")))


def domain_growth_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("i", F.round("t", 3).alias("t"), "domains")


def growth_fit(spark, sf_dir):
    out = report.growth_fit(_curve(spark, sf_dir))
    return out.select(F.col("peak").cast("long").alias("peak"), *[F.round(c, 6).alias(c) for c in ("linear_k", "root_k", "linear_r2", "root_r2", "early", "late", "slowdown")], "verdict", F.round("projected", 1).alias("projected"))


def resource_peaks(spark, sf_dir):
    """Peaks of telemetry columns, and the page rate that the domains allow at the minimum gap."""
    s = r.runstats(spark, sf_dir).join(r.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "value", "user_id"), "seq")
    return s.groupBy("shard").agg(F.max("value").alias("peak_value"), F.max("crawled").alias("peak_crawled"), F.count_distinct("user_id").alias("domains")).withColumn("ceiling_pages_per_s", F.round(F.col("domains") / 5.0, 6)).withColumn("peak_value", F.round("peak_value", 6))


def crawled_log_roundtrip(spark, sf_dir):
    """Crawl rows written as log lines and read again: counts by status."""
    back = parse_crawled(crawled_lines(r.crawled(spark, sf_dir)))
    return back.groupBy("status", "content_type").agg(F.count("*").alias("n"), F.sum("n_links").alias("links"), F.sum("bytes").alias("bytes"), F.count_distinct(slot_key(F.col("url"))).alias("domains"))


QUERIES = {f.__name__: f for f in (crawl_metrics, status_counts, latency_p50_p90, unique_ok, discovered_unique, approx_domains, timeline_buckets, timeline_combined, domain_growth_curve, growth_fit, resource_peaks, crawled_log_roundtrip)}

_C = """c AS (SELECT epoch_us(ts) / 1000000.0 AS sent, epoch_us(ts) / 1000000.0 + value / 10 AS recv, user_id, event_id, event_type, value,
  CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' ELSE '200' END AS status, json_extract(props, '$.k')::BIGINT AS k FROM events)"""
_S = f"""{_C}, s AS (SELECT (user_id % 2)::INT AS shard, event_id AS seq, sent - (SELECT min(sent) FROM c) AS elapsed, value, user_id,
  count(*) OVER w AS crawled, (sum(k) OVER w)::BIGINT AS discovered FROM c WINDOW w AS (PARTITION BY user_id % 2 ORDER BY sent, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT shard, floor(elapsed / {BUCKET})::BIGINT AS bucket, arg_max(elapsed, seq) AS elapsed, arg_max(crawled, seq) AS crawled, arg_max(discovered, seq) AS discovered FROM s GROUP BY 1, 2)"""
_HREF = r"""regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]+"|''[^'']+''|[^\s"''<>`]+)', 1)"""
_G = f"""{_C}, x AS (SELECT sent AS t, 'k' || (event_id % 700) || '.' || user_id AS key, row_number() OVER (ORDER BY sent, 'k' || (event_id % 700) || '.' || user_id) AS rn FROM c),
y AS (SELECT t, rn, sum(CASE WHEN f = rn THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS seen FROM (SELECT *, min(rn) OVER (PARTITION BY key) AS f FROM x)),
b AS (SELECT min(t) AS lo, (max(t) - min(t)) AS span, count(*) AS n FROM x),
acc(j, mark) AS (SELECT 1, (SELECT span / 40 FROM b) UNION ALL SELECT j + 1, mark + (SELECT span / 40 FROM b) FROM acc WHERE j < 41),
m AS (SELECT j, mark, span, n, (SELECT count(*) FROM x WHERE t - lo < mark) + 1 AS f FROM b, acc),
p AS (SELECT j, mark, n, j + max(f - j) OVER (ORDER BY j) AS rn FROM m),
curve AS (SELECT (p.j - 1)::INT AS i, p.mark AS t, y.seen::BIGINT AS domains FROM p JOIN y ON p.rn = y.rn
  UNION ALL SELECT (SELECT count(*) FROM p JOIN y ON p.rn = y.rn)::INT, (SELECT span FROM b), (SELECT max(seen) FROM y)::BIGINT)"""
ORACLE_SQL = {
    "crawl_metrics": f"""WITH {_C}, f AS (SELECT count(DISTINCT h) AS u FROM (SELECT trim(unnest({_HREF}), '"''') AS h FROM pages) WHERE h <> ''),
m AS (SELECT count(*) AS n, count(*) FILTER (status LIKE '2%') AS ok, sum(k) AS k, sum(event_id % 4096) AS b, count(DISTINCT user_id) AS d, max(recv) - min(sent) AS s FROM c)
SELECT n AS crawled, ok, k::BIGINT AS links, b::BIGINT AS bytes, 0::BIGINT AS missing_stamp, d AS domains, u AS discovered_unique, round(s, 6) AS elapsed, round(n / s, 6) AS pages_per_s,
  round(k / n, 6) AS links_per_page, round(u / n, 6) AS new_per_page, round(n / s * 172800, 3) AS projected, round(n / s * 172800 * (u / n), 3) AS projected_links FROM m, f""",
    "status_counts": f"WITH {_C} SELECT status, count(*) AS n FROM c GROUP BY 1",
    "latency_p50_p90": f"""WITH {_C}, l AS (SELECT recv - sent AS v, row_number() OVER (ORDER BY recv - sent) AS rn, count(*) OVER () AS n FROM c)
SELECT round(max(v) FILTER (rn = floor(n * 0.5) + 1), 4) AS p50, round(max(v) FILTER (rn = floor(n * 0.9) + 1), 4) AS p90 FROM l""",
    "unique_ok": "SELECT count(DISTINCT (user_id, event_type, event_id % 1000)) AS unique_ok, count(*) AS rows_ok FROM events WHERE event_type <> 'error'",
    "discovered_unique": f"SELECT count(*) AS discovered, count(DISTINCT h) AS discovered_unique FROM (SELECT trim(unnest({_HREF}), '\"''') AS h FROM pages) WHERE h <> ''",
    "timeline_buckets": f"""WITH {_S}, l AS (SELECT *, greatest(elapsed - coalesce(lag(elapsed) OVER w, 0), 1.0) AS span, crawled - coalesce(lag(crawled) OVER w, 0) AS dc,
  discovered - coalesce(lag(discovered) OVER w, 0) AS dd FROM e WINDOW w AS (PARTITION BY shard ORDER BY bucket))
SELECT shard, bucket, crawled, discovered, round(elapsed, 6) AS elapsed, round(dc / span, 6) AS pages_per_s, round(dd / span, 6) AS links_per_s FROM l""",
    "timeline_combined": f"WITH {_S} SELECT count(*) AS shards, sum(c)::BIGINT AS combined FROM (SELECT shard, max(crawled) AS c FROM e GROUP BY 1)",
    "domain_growth_curve": f"WITH RECURSIVE {_G} SELECT i, round(t, 3) AS t, domains FROM curve",
    "growth_fit": f"""WITH RECURSIVE {_G}, q AS (SELECT count(*) AS n, count(*) // 3 AS th FROM curve),
f AS (SELECT max(domains) AS peak, sum(t * domains) / sum(t * t) AS lk, sum(sqrt(t) * domains) / sum(t) AS rk FROM curve),
r AS (SELECT any_value(peak) AS peak, any_value(lk) AS lk, any_value(rk) AS rk, 1 - sum((domains - lk * t) ** 2) / sum((domains - mean) ** 2) AS linear_r2,
  1 - sum((domains - rk * sqrt(t)) ** 2) / sum((domains - mean) ** 2) AS root_r2 FROM curve, f, (SELECT avg(domains) AS mean FROM curve)),
z AS (SELECT (max(domains) FILTER (i = th) - max(domains) FILTER (i = 0)) / (max(t) FILTER (i = th) - max(t) FILTER (i = 0)) AS early,
  (max(domains) FILTER (i = n - 1) - max(domains) FILTER (i = n - th - 1)) / (max(t) FILTER (i = n - 1) - max(t) FILTER (i = n - th - 1)) AS late FROM curve, q)
SELECT peak, round(lk, 6) AS linear_k, round(rk, 6) AS root_k, round(linear_r2, 6) AS linear_r2, round(root_r2, 6) AS root_r2, round(early, 6) AS early, round(late, 6) AS late, round(CASE WHEN early > 0 THEN late / early END, 6) AS slowdown,
  CASE WHEN late <= 0 THEN 'turned over' WHEN greatest(linear_r2, root_r2) < 0.5 THEN 'unreliable' WHEN linear_r2 >= root_r2 THEN 'linear' ELSE 'root' END AS verdict,
  round(CASE WHEN late <= 0 THEN NULL WHEN linear_r2 >= root_r2 THEN lk * 172800 ELSE rk * sqrt(172800) END, 1) AS projected FROM r, z""",
    "resource_peaks": f"WITH {_S} SELECT shard, round(max(value), 6) AS peak_value, max(crawled) AS peak_crawled, count(DISTINCT user_id) AS domains, round(count(DISTINCT user_id) / 5.0, 6) AS ceiling_pages_per_s FROM s GROUP BY 1",
    "crawled_log_roundtrip": f"WITH {_C} SELECT status, 'text/html' AS content_type, count(*) AS n, sum(k)::BIGINT AS links, sum(event_id % 4096)::BIGINT AS bytes, count(DISTINCT user_id) AS domains FROM c GROUP BY 1",
}
