"""Queries: the streaming operators, run to the end of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkfrontier.functions.urls import without_fragment
from sparkfrontier.sources import relations as r
from sparkfrontier.streaming import stateful


def _stream(spark, sf_dir, table):
    return spark.readStream.schema(r.table(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parquet*")


def _name(kind):
    return f"{kind}_{uuid.uuid4().hex}"


def stream_dedup(spark, sf_dir):
    urls = _stream(spark, sf_dir, "pages").select(without_fragment(F.col("url")).alias("url"))
    return stateful.run_to_end(stateful.dedup(urls), _name("dedup")).select("url", "fp")


def stream_guard(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")).alias("slot_id"), r.epoch(F.col("ts")).alias("dispatch_ts"), "event_id")
    out = stateful.run_to_end(stateful.guard(rows, 7200.0, expire=False), _name("guard"))
    return out.groupBy("slot_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def stream_counts(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id"))
    return stateful.run_to_end(stateful.running_counts(rows, "user_id"), _name("counts"), "complete")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_guard, stream_counts)}
ORACLE_SQL = {
    "stream_dedup": """SELECT DISTINCT split_part(url, '#', 1) AS url, sha1('{"body": "", "headers": {}, "method": "GET", "url": "' || split_part(url, '#', 1) || '"}') AS fp FROM pages""",
    "stream_guard": """WITH d AS (SELECT epoch_us(ts) / 1000000.0 AS t, 'u' || user_id || '.example' AS slot_id, event_id FROM events),
l AS (SELECT slot_id, count(*) AS n, list(t ORDER BY t, event_id) AS ts FROM d GROUP BY slot_id),
a AS (SELECT slot_id, n, list_reduce(list_prepend({'last': -1e18::DOUBLE, 'k': 0::BIGINT}, list_transform(ts, lambda x: {'last': x::DOUBLE, 'k': 1::BIGINT})),
  lambda acc, x: CASE WHEN x.last - acc.last >= 7199.95 THEN {'last': x.last, 'k': acc.k + 1} ELSE acc END).k AS accepted FROM l)
SELECT slot_id, accepted, n - accepted AS refused FROM a""",
    "stream_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
}
