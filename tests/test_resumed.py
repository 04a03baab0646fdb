"""Registered domains by rules, schedules after a restart, reports with what they leave out."""

from sparkfrontier.functions.domains import registered
from sparkfrontier.operators.audit import violations
from sparkfrontier.operators.frontier import limiter_schedule
from sparkfrontier.operators.report import crawl_metrics, parseable


def test_registered_domains_by_each_kind_of_rule(spark):
    rules = spark.createDataFrame([(x,) for x in ("com", "uk", "co.uk", "github.io", "io", "*.ck", "!www.ck")], "rule string")
    want = {
        "a.b.com": "b.com", "com": "com", "x.co.uk": "x.co.uk", "a.x.co.uk": "x.co.uk", "co.uk": "co.uk", "q.me.github.io": "me.github.io", "s.y.z.ck": "y.z.ck",
        "z.ck": "z.ck", "a.www.ck": "www.ck", "www.ck": "www.ck", "deep.host.intranet": "deep.host.intranet", "10.0.0.1": "10.0.0.1", "::1": "::1", "A.B.COM": "b.com", "b.com.": "b.com", "": "__nohost__",
    }
    hosts = spark.createDataFrame([(h, 1) for h in want] + [(None, 1), ("a.b.com", 2)], "host string, slot int")
    got = [(r["host"], r["slot"]) for r in registered(hosts, rules).collect()]
    assert len(got) == len(want) + 2
    assert all(slot == want.get(host, "__nohost__") for host, slot in got)


def test_no_rules_leave_every_host_its_own(spark):
    none = spark.createDataFrame([], "rule string")
    hosts = spark.createDataFrame([("a.b.com",)], "host string")
    assert registered(hosts, none).first()["slot"] == "a.b.com"
    assert registered(hosts.limit(0), none).count() == 0


def test_a_schedule_goes_on_from_its_history(spark):
    rows = [("a", 1, 10.0, 2.0), ("a", 2, 11.0, 2.0), ("b", 3, 10.0, 1.0), ("b", 4, 10.5, 1.0), ("c", 5, 10.0, 1.0)]
    arrivals = spark.createDataFrame(rows, "slot string, seq long, arrive double, rtt double")
    done = spark.createDataFrame([("a", 9.0), ("c", 1.0)], "slot string, last_complete double")
    slow = spark.createDataFrame([("b", 20.0), ("c", 1.0)], "slot string, crawl_delay double")
    got = {r["seq"]: r["start"] for r in limiter_schedule(arrivals, 5.0, done, slow).collect()}
    last, want = {"a": 9.0, "c": 1.0}, {}
    for slot, seq, arrive, rtt in rows:
        pause = 20.0 if slot == "b" else 5.0  # a crawl delay under the floor doesn't hold
        want[seq] = max(arrive, last[slot] + pause) if slot in last else arrive
        last[slot] = want[seq] + rtt
    assert got == want


def test_violations_count_what_is_not_shown(spark):
    rows = spark.createDataFrame([("a", float(i), i) for i in range(10)], "slot_id string, dispatch_ts double, event_id long")
    shown = violations(rows, 5.0, show=4).collect()
    assert [r["not_shown"] for r in shown] == [5] * 4
    assert {r["not_shown"] for r in violations(rows, 5.0, show=20).collect()} == {0}


def test_metrics_project_different_links(spark):
    rows = spark.createDataFrame([("200", 3, 10, 0.0, 1.0, "a"), ("500", 1, 10, 1.0, 2.0, "b"), (None, 0, 0, 1.0, 2.0, "b")], "status string, n_links long, bytes long, sent_ts double, recv_ts double, slot_id string")
    found = spark.createDataFrame([("u",), ("u",), ("v",), ("w",)], "url string")
    got = crawl_metrics(rows, found).first()
    assert (got["discovered_unique"], got["new_per_page"]) == (3, 1.0)
    assert got["projected_links"] == got["projected"] == 1.5 * 172800
    assert "new_per_page" not in crawl_metrics(rows).columns
    assert [r["slot_id"] for r in parseable(rows).collect()] == ["a"]
