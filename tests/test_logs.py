import gzip

from pyspark.sql import functions as F

from sparkfrontier.sources import logs


def test_damaged_member_loses_no_intact_row(spark, tmp_path):
    f = tmp_path / "x.log.gz"
    member = lambda name, n: gzip.compress("".join(f"{name}-{i}\n" for i in range(n)).encode())
    f.write_bytes(member("pre", 100) + member("killed", 500)[:-60] + member("post", 200))
    rows = logs.read_gzip_lines(spark, str(f)).collect()
    lines = [r["line"] for r in rows if r["line"] is not None]
    assert [x for x in lines if x.startswith("pre")] == [f"pre-{i}" for i in range(100)]
    assert [x for x in lines if x.startswith("post")] == [f"post-{i}" for i in range(200)]
    assert set(lines) <= {f"pre-{i}" for i in range(100)} | {f"killed-{i}" for i in range(500)} | {f"post-{i}" for i in range(200)}
    assert sum(r["damaged"] for r in rows) == 1


def test_clean_members_read_whole(spark, tmp_path):
    f = tmp_path / "x.log.gz"
    f.write_bytes(b"".join(gzip.compress("".join(f"{m}-{i}\n" for i in range(1000)).encode()) for m in range(3)) + gzip.compress(b"no newline"))
    lines = [r["line"] for r in logs.read_gzip_lines(spark, str(f)).orderBy("seq").collect()]
    assert lines == [f"{m}-{i}" for m in range(3) for i in range(1000)] + ["no newline"]


def test_dispatch_states_and_clocks(spark):
    lines = ["1000.000\ta.test\tu\t500.0", "1005.200\ta.test\tu\t505.2", "NA\ta\tu\t1", "x\ta\tu", "5.0", "7.0\ta"]
    got = [tuple(r) for r in logs.parse_dispatched(spark.createDataFrame([(x,) for x in lines], "line string")).select("state", "dispatch_ts", "monotonic_ts").collect()]
    assert got == [("ok", 1000.0, 500.0), ("ok", 1005.2, 505.2), ("uncheckable", None, 1.0), ("unreadable", None, None), ("short", 5.0, None), ("ok", 7.0, None)]


def test_crawled_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.5, "http://x/\ta", "200", "text/html; charset=x", 3, 9), (None, 2.0, "u", "404", "", 0, 0)], "sent_ts double, recv_ts double, url string, status string, content_type string, n_links long, bytes long")
    logs.write_lines(logs.crawled_lines(rows), str(tmp_path / "out"))
    back = logs.parse_crawled(spark.read.text(str(tmp_path / "out")).withColumnRenamed("value", "line")).orderBy("status").collect()
    assert [(r["sent"], r["recv_ts"], r["url"], r["content_type"], r["bytes"]) for r in back] == [("1.000", 2.5, "http://x/%09a", "text/html", 9), ("NA", 2.0, "u", "", 0)]
    six = logs.parse_crawled(spark.createDataFrame([("1\t2\tu\t200\tt\t5",), ("short\tline",)], "line string")).collect()
    assert len(six) == 1 and six[0]["bytes"] is None


def test_tsv_drops_bad_rows(spark, tmp_path):
    f = tmp_path / "r.tsv"
    f.write_text("elapsed\trss\n1\t2\n3\n4\tx\n5\t6\n")
    assert [tuple(r) for r in logs.read_tsv(spark, str(f)).orderBy("elapsed").collect()] == [(1.0, 2.0), (5.0, 6.0)]


def test_lists_and_tables_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "url string, n int").coalesce(1)
    logs.write_list(rows.where("url is not null"), "url", str(tmp_path / "list"), ["2 seeds"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["# 2 seeds", "b", "a"]
    logs.write_tsv(rows.orderBy(F.desc("n")), str(tmp_path / "tsv"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()][:2] == ["url\tn", "\t3"]
