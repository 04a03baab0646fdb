"""Queries: telemetry and run control."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfrontier.operators import report, telemetry
from sparkfrontier.sources import relations as r


def stats_counters(spark, sf_dir):
    e = r.events(spark, sf_dir).select(F.col("event_type").alias("metric"), F.col("k").alias("value"), F.col("event_id").alias("seq"))
    return telemetry.counters(e, "metric", "value")


def lag_samples(spark, sf_dir):
    e = r.events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400).cast("long"))
    return telemetry.sampled_median(e, ["day"], "value").select("day", F.round("median", 6).alias("median"), F.round("highest", 6).alias("highest"))


def cpu_percent(spark, sf_dir):
    return telemetry.rates(r.runstats(spark, sf_dir), "shard", "elapsed", "crawled").select("shard", "seq", F.round("percent", 9).alias("percent"))


def failure_streaks(spark, sf_dir):
    e = r.events(spark, sf_dir).select("user_id", "t", "event_id", "event_type")
    streaks = telemetry.failure_streaks(e, "user_id", ["t", "event_id"], F.col("event_type").isin("error", "click"))
    return streaks.groupBy(F.col("failures").cast("long").alias("failures"), "ttl").agg(F.count("*").alias("n"))


def queue_folders(spark, sf_dir):
    c = r.table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("-")).alias("slot"))
    folder = telemetry.queue_folder(F.col("slot"))
    return c.select("c_custkey", folder.alias("folder"), telemetry.slot_of_folder(folder).alias("slot"))


def run_actions(spark, sf_dir):
    stats = F.concat(F.lit('{"finish_reason": "'), F.when(F.col("event_type") == "click", "run_duration").when(F.col("event_type") == "view", "memusage_exceeded").when(F.col("event_type") == "signup", "").otherwise("cancelled"), F.lit('"}'))
    e = r.events(spark, sf_dir).select(telemetry.finish_reason(stats).alias("reason"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("code"), (F.col("event_id") % 13).alias("crashes"))
    return e.groupBy("reason", telemetry.run_action(F.col("reason"), F.col("code"), F.col("crashes")).alias("action")).agg(F.count("*").alias("n"))


def type_histogram(spark, sf_dir):
    return telemetry.histogram(r.events(spark, sf_dir), "event_type", 3)


def metrics_as_json(spark, sf_dir):
    """Totals through JSON and back."""
    text = telemetry.metrics_json(report.crawl_metrics(r.crawled(spark, sf_dir)))
    return text.select(F.from_json("json", "crawled long, ok long, links long, domains long, missing_stamp long").alias("m")).select("m.*")


QUERIES = {f.__name__: f for f in (stats_counters, lag_samples, cpu_percent, failure_streaks, queue_folders, run_actions, type_histogram, metrics_as_json)}

_C = "c AS (SELECT epoch_us(ts) / 1000000.0 AS t, user_id, event_id, event_type, value, json_extract(props, '$.k')::BIGINT AS k FROM events)"
ORACLE_SQL = {
    "stats_counters": f"WITH {_C} SELECT event_type AS metric, sum(k)::BIGINT AS total, max(k) AS highest, arg_max(k, event_id) AS latest FROM c GROUP BY 1",
    "lag_samples": f"""WITH {_C}, d AS (SELECT floor(t / 86400)::BIGINT AS day, value, row_number() OVER (PARTITION BY floor(t / 86400) ORDER BY value) AS rn, count(*) OVER (PARTITION BY floor(t / 86400)) AS n FROM c)
SELECT day, round(max(value) FILTER (rn = n // 2 + 1), 6) AS median, round(max(value), 6) AS highest FROM d GROUP BY 1""",
    "cpu_percent": f"""WITH {_C}, s AS (SELECT (user_id % 2)::INT AS shard, event_id AS seq, t - (SELECT min(t) FROM c) AS elapsed, count(*) OVER (PARTITION BY user_id % 2 ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS crawled FROM c),
g AS (SELECT shard, seq, elapsed - lag(elapsed) OVER w AS span, crawled - lag(crawled) OVER w AS d FROM s WINDOW w AS (PARTITION BY shard ORDER BY elapsed, crawled))
SELECT shard, seq, round(CASE WHEN span > 0 THEN d / span END, 9) AS percent FROM g""",
    "failure_streaks": f"""WITH {_C}, f AS (SELECT user_id, t, event_id, event_type IN ('error', 'click') AS failed FROM c),
e AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS era FROM f),
n AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, era ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM e)
SELECT failures::BIGINT AS failures, least(300.0 * 2.0 ** least(greatest(failures - 1, 0), 32), 14400.0)::DOUBLE AS ttl, count(*) AS n FROM n WHERE failed GROUP BY 1, 2""",
    "queue_folders": """WITH s AS (SELECT c_custkey, replace(c_name, '#', '-') AS slot, regexp_replace(replace(c_name, '#', '-'), '[^a-zA-Z0-9._]', '_', 'g') AS safe FROM customer)
SELECT c_custkey, safe || '-' || md5(slot) AS folder, CASE WHEN safe = slot THEN slot END AS slot FROM s""",
    "run_actions": """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'run_duration' WHEN 'view' THEN 'memusage_exceeded' WHEN 'signup' THEN '' ELSE 'cancelled' END AS reason, event_id % 5 = 0 AS bad, event_id % 13 AS crashes FROM events)
SELECT reason, CASE WHEN bad THEN CASE WHEN crashes < 10 THEN 'restart' ELSE 'stop' END WHEN reason IN ('', 'run_duration') THEN 'done' WHEN reason = 'memusage_exceeded' THEN 'restart' ELSE 'stop' END AS action, count(*) AS n FROM e GROUP BY 1, 2""",
    "type_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
    "metrics_as_json": f"WITH {_C} SELECT count(*) AS crawled, count(*) FILTER (event_type <> 'error') AS ok, sum(k)::BIGINT AS links, count(DISTINCT user_id) AS domains, 0::BIGINT AS missing_stamp FROM c",
}
