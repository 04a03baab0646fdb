import zipfile

from pyspark.sql import functions as F

from sparkfrontier.operators import telemetry
from sparkfrontier.sources.ranked import read_ranked


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 1.0, 3.0, 2.0)], "k string, v double")
    assert tuple(telemetry.sampled_median(df, ["k"], "v").first()) == ("a", 3.0, 4.0)


def test_streaks_reset_on_success(spark):
    rows = [("n", i, ok) for i, ok in enumerate([False, False, True, False, False, False])]
    got = telemetry.failure_streaks(spark.createDataFrame(rows, "k string, i long, ok boolean"), "k", ["i"], ~F.col("ok")).orderBy("i").collect()
    assert [(r["failures"], r["ttl"]) for r in got] == [(1, 300.0), (2, 600.0), (1, 300.0), (2, 600.0), (3, 1200.0)]


def test_queue_folders_round_trip(spark):
    names = ["a.example", "ü.example", "x-y.example"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", telemetry.slot_of_folder(telemetry.queue_folder(F.col("s"))).alias("back"))
    assert {r["s"]: r["back"] for r in df.collect()} == {"a.example": "a.example", "ü.example": None, "x-y.example": None}


def test_actions(spark):
    rows = [("run_duration", 0, 0), ("", 0, 0), ("memusage_exceeded", 0, 0), ("cancelled", 0, 0), ("run_duration", 1, 3), ("x", 1, 10)]
    got = spark.createDataFrame(rows, "r string, c int, n int").select(telemetry.run_action(F.col("r"), F.col("c"), F.col("n")).alias("a")).collect()
    assert [r["a"] for r in got] == ["done", "done", "restart", "stop", "restart", "stop"]


def test_ranked_lists(spark, tmp_path):
    (tmp_path / "l.csv").write_text("1,a.example\n2,b.example\n")
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("top.csv", "1,a.example\nbad\n2,b.example\n")
    for name in ("l.csv", "l.zip"):
        assert [tuple(r) for r in read_ranked(spark, str(tmp_path / name)).orderBy("rank").collect()] == [(1, "a.example"), (2, "b.example")]
