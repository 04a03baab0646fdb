"""Queries: compliance audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfrontier.functions.domains import shard_of
from sparkfrontier.operators import audit
from sparkfrontier.sources import relations as r
from sparkfrontier.sources.logs import parse_dispatched

GAP = 3600.0


def politeness_verdict(spark, sf_dir):
    return audit.politeness_verdict(r.dispatched(spark, sf_dir), GAP).withColumn("min_gap", F.round("min_gap", 3))


def politeness_pass(spark, sf_dir):
    return audit.politeness_verdict(r.dispatched(spark, sf_dir), 0.001).withColumn("min_gap", F.round("min_gap", 3))


def politeness_violations_top(spark, sf_dir):
    return audit.violations(r.dispatched(spark, sf_dir), GAP).select("slot_id", F.round("dispatch_ts", 3).alias("dispatch_ts"), F.round("gap", 3).alias("gap"), "not_shown")


def gap_histogram(spark, sf_dir):
    g = audit.gaps(r.dispatched(spark, sf_dir)).where(F.col("gap").isNotNull())
    return g.groupBy(F.floor(F.col("gap") / 3600).cast("long").alias("hours")).agg(F.count("*").alias("n"))


def guard_replay(spark, sf_dir):
    return audit.guard_replay(r.dispatched(spark, sf_dir), 7200.0).groupBy("slot_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def refetch_summary(spark, sf_dir):
    return audit.refetch_summary(r.table(spark, sf_dir, "conversations"), "conv_id")


def refetch_repeats(spark, sf_dir):
    return audit.repeats(r.table(spark, sf_dir, "conversations"), "conv_id").orderBy(F.desc("n"), "conv_id").limit(20)


def shard_ownership_check(spark, sf_dir):
    rows = r.dispatched(spark, sf_dir).withColumn("shard", shard_of(F.col("slot_id"), 4))
    return audit.ownership(rows, "slot_id", "shard").agg(F.count("*").alias("domains"), F.count_if(F.col("shards") > 1).alias("foreign_domains"))


def log_states(spark, sf_dir):
    return parse_dispatched(r.log_lines(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"), F.count("monotonic_ts").alias("with_monotonic"))


QUERIES = {f.__name__: f for f in (politeness_verdict, politeness_pass, politeness_violations_top, gap_histogram, guard_replay, refetch_summary, refetch_repeats, shard_ownership_check, log_states)}

_D = """d AS (SELECT epoch_us(ts) / 1000000.0 AS t, 'u' || user_id || '.example' AS slot_id, event_id, event_type FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY slot_id ORDER BY t, event_id) AS gap FROM d)"""
_VERDICT = f"""WITH {_D} SELECT count(*) AS requests, count(DISTINCT slot_id) AS domains, round(min(gap), 3) AS min_gap,
count(*) FILTER (gap < {{0}} - 0.05) AS violations, 0::BIGINT AS uncheckable, count(*) FILTER (gap < {{0}} - 0.05) = 0 AS ok FROM g"""
ORACLE_SQL = {
    "politeness_verdict": _VERDICT.format(GAP),
    "politeness_pass": _VERDICT.format(0.001),
    "politeness_violations_top": f"WITH {_D} SELECT slot_id, round(t, 3) AS dispatch_ts, round(gap, 3) AS gap, greatest((SELECT count(*) FROM g WHERE gap < {GAP} - 0.05) - 20, 0)::BIGINT AS not_shown FROM g WHERE gap < {GAP} - 0.05 ORDER BY g.gap, slot_id, t LIMIT 20",
    "gap_histogram": f"WITH {_D} SELECT floor(gap / 3600)::BIGINT AS hours, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "guard_replay": f"""WITH {_D}, l AS (SELECT slot_id, count(*) AS n, list(t ORDER BY t, event_id) AS ts FROM d GROUP BY slot_id),
a AS (SELECT slot_id, n, list_reduce(list_prepend({{'last': -1e18::DOUBLE, 'k': 0::BIGINT}}, list_transform(ts, lambda x: {{'last': x::DOUBLE, 'k': 1::BIGINT}})),
  lambda acc, x: CASE WHEN x.last - acc.last >= 7199.95 THEN {{'last': x.last, 'k': acc.k + 1}} ELSE acc END).k AS accepted FROM l)
SELECT slot_id, accepted, n - accepted AS refused FROM a""",
    "refetch_summary": "SELECT sum(n)::BIGINT AS rows, count(*) AS urls, count(*) FILTER (n > 1) AS repeated, sum(n - 1)::BIGINT AS wasted FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)",
    "refetch_repeats": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, conv_id LIMIT 20",
    "shard_ownership_check": "SELECT count(DISTINCT user_id) AS domains, 0::BIGINT AS foreign_domains FROM events",
    "log_states": """WITH l AS (SELECT event_id, event_id % 83 = 0 AS short, event_id % 97 = 0 AS na, event_id % 97 <> 0 AND event_id % 89 = 0 AS bad, event_id % 2 = 0 AS three FROM events),
s AS (SELECT CASE WHEN short THEN 'short' WHEN na THEN 'uncheckable' WHEN bad AND three THEN 'unreadable' ELSE 'ok' END AS state, NOT short AND NOT three AS mono FROM l)
SELECT state, count(*) AS n, count(*) FILTER (mono) AS with_monotonic FROM s GROUP BY 1""",
}
