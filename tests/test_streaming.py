from pyspark.sql import functions as F

from sparkfrontier.functions.domains import shard_of
from sparkfrontier.operators import audit
from sparkfrontier.streaming import stateful


def test_guard_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("slot_id"), (F.col("id") * 1.7).alias("dispatch_ts"), F.col("id").alias("event_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = stateful.run_to_end(stateful.guard(stream, 30.0, expire=False), "guard_test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, audit.guard_replay(rows, 30.0).collect()))


def test_handoff_delivers_each_row_once_to_its_owner(spark, tmp_path):
    urls = spark.range(200).select(F.concat(F.lit("https://d"), F.col("id").cast("string"), F.lit(".example/")).alias("url"))
    urls.write.parquet(str(tmp_path / "out"))
    source = lambda: spark.readStream.schema("url string").parquet(str(tmp_path / "out"))
    for _ in range(2):  # a restart sends nothing again
        query = stateful.write_handoff(source(), "url", 3, str(tmp_path / "box"), str(tmp_path / "check"))
        assert query.awaitTermination(120)
    got = {}
    for owner in range(3):
        inbox = stateful.read_handoff(spark, str(tmp_path / "box"), "url string", owner, 3, "url")
        got[owner] = [r["url"] for r in stateful.run_to_end(inbox, f"box_{owner}").collect()]
    want = {r["url"]: r["s"] for r in urls.select("url", shard_of(F.col("url"), 3).alias("s")).collect()}
    assert sorted(u for x in got.values() for u in x) == sorted(want)
    assert all(want[u] == owner for owner, x in got.items() for u in x)


def test_dedup_stream_keeps_the_first(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    assert sorted(r["url"] for r in stateful.run_to_end(stateful.dedup(stream), "dedup_test").collect()) == ["a", "b"]
