"""Ranges, canonical URLs, counters, replays and log files against brute force."""

import gzip
import json
import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkfrontier.functions import links, urls
from sparkfrontier.operators import frontier, running
from sparkfrontier.sources import logs


def test_equal_values_spread_over_ranges(spark):
    rows = spark.range(40_000).select(F.lit(7).alias("v"), "id")
    ranged = rows.select(running.Cuts(rows, ["v", "id"], 16).range_of().alias("r")).groupBy("r").count().toPandas()
    assert len(ranged) == 16 and ranged["count"].max() < 3 * 40_000 / 16
    got = running.numbered(rows, "v", ["id"], {"total": F.col("id")}, parts=16).orderBy("id").toPandas()
    assert got.row_index.tolist() == list(range(1, 40_001)) and got.total.tolist() == got.id.cumsum().tolist()


def test_row_numbers_of_mixed_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 0.5, 1.25, 2.0]), rng.choice(["a", "b é", 'q"', None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, w string, i long").repartition(4)
    got = {r["i"]: r["row_index"] for r in running.numbered(df, "v", ["w", "i"], parts=20).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(rows, key=lambda r: (low(r[0]), (r[1] is not None, (r[1] or "").encode()), r[2]))
    assert got == {r[2]: k + 1 for k, r in enumerate(order)}


@pytest.mark.parametrize("values", [list(range(3000)), [5.0] * 3000, [i % 7 for i in range(3000)]])
def test_order_statistics(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [0, 1, 1499, 2700, 2999]
    assert running.order_statistics(df, "v", [*ranks, 3000], held=50) == [sorted(values)[k] for k in ranks] + [None]
    assert running.upper_indexes(df, "v", [0.5, 0.9]) == [sorted(values)[1500], sorted(values)[2700]]
    assert running.upper_indexes(df.limit(0), "v", [0.5]) == [None]


CANONICAL = {
    "https://example.com/": "https://example.com/",
    "https://example.com": "https://example.com/",
    "https://EXAMPLE.com/": "https://example.com/",
    "https://example.com:443/": "https://example.com:443/",
    "http://example.com:80/path": "http://example.com:80/path",
    "https://example.com/a?b=2&a=1": "https://example.com/a?a=1&b=2",
    "https://example.com/a?a=1&b=2": "https://example.com/a?a=1&b=2",
    "https://example.com/p?z=1#frag": "https://example.com/p?z=1",
    "https://example.com/%7Euser/": "https://example.com/~user/",
    "https://example.com/~user/": "https://example.com/~user/",
    "http://example.com/path/./x/../y": "http://example.com/path/./x/../y",
    "https://例え.テスト/パス?q=値": "https://xn--r8jz45g.xn--zckzah/%E3%83%91%E3%82%B9?q=%E5%80%A4",
    "https://example.com/a b c": "https://example.com/a%20b%20c",
    "https://example.com/?": "https://example.com/",
    "https://example.com/x?a+b=c%20d&u=/e/f&blank": "https://example.com/x?a+b=c+d&blank=&u=%2Fe%2Ff",
    "https://bücher.example:8080/%2fa%3fb": "https://xn--bcher-kva.example:8080/%2Fa%3Fb",
    "https://sub.example.co.uk/deep/path/here?x=1&y=2&z=3": "https://sub.example.co.uk/deep/path/here?x=1&y=2&z=3",
    "https://example.com/" + "a" * 500: "https://example.com/" + "a" * 500,
}


@pytest.mark.parametrize("url", CANONICAL)
def test_canonical_urls(url):
    assert urls.canonical(url) == CANONICAL[url] == urls.canonical(CANONICAL[url])


def test_fingerprints_are_of_ascii_json(spark):
    import hashlib

    cases = ["http://a.example/x", 'http://a.example/"\\', "http://bücher.example/\U0001f600\n"]
    want = [hashlib.sha1(json.dumps({"body": "", "headers": {}, "method": "GET", "url": u}, sort_keys=True).replace("\\n", "\\u000a").encode()).hexdigest() for u in cases]
    got = spark.createDataFrame([(u,) for u in cases], "u string").select(urls.fingerprint(F.col("u")), F.hex(urls.hash128(F.col("u")))).collect()
    assert [r[0] for r in got] == want and [r[1].lower() for r in got] == [w[:32] for w in want]


def test_links_are_joined_once(spark):
    pages = spark.createDataFrame([(1, "https://p.example/a/", "<a href=b>x</a><a href='b'>y</a><a href='../c?z=1&y=2'>")], "page_id long, url string, html string")
    out = links.page_links(pages)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["link"], r["pos"]) for r in out.collect()) == [("https://p.example/a/../c?y=2&z=1", 2), ("https://p.example/a/b", 0)] or sorted(r["pos"] for r in out.collect()) == [0, 2]


def test_caps_go_on_after_stored_counters(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)] + [("c", 9)], "slot string, seq long")
    stored = spark.createDataFrame([("a", 3), ("d", 7)], "slot string, count long")
    kept = frontier.capped_after(rows, stored, "slot", "seq", 4)
    assert sorted((r["slot"], r["seq"], r["nth"]) for r in kept.collect()) == [("a", 0, 4), *[("b", i, i + 1) for i in range(4)], ("c", 9, 1)]
    assert {r["slot"]: r["count"] for r in frontier.counters_after(stored, kept, "slot").collect()} == {"a": 4, "b": 4, "c": 1, "d": 7}


def test_a_drained_queue_frees_its_place(spark):
    rng = random.Random(7)
    events = [(s, i, f"d{rng.randrange(9)}", rng.choice(["put", "put", "take"])) for s in range(3) for i in range(400)]
    got = {(r["shard"], r["seq"]): r["verdict"] for r in frontier.admission_replay(spark.createDataFrame(events, "shard int, seq long, slot string, kind string").repartition(5), queues=5, cap=12).collect()}
    want = {}
    for s in range(3):
        live, seen = Counter(), set()
        for _, i, slot, kind in (e for e in events if e[0] == s):
            if kind == "take":
                live[slot] = max(0, live[slot] - 1)
                continue
            size, queues, fresh = sum(live.values()), sum(v > 0 for v in live.values()), slot not in seen
            seen.add(slot)
            want[s, i] = "over_queues" if not live[slot] and queues >= 5 else "over_capacity" if size >= 12 and not (fresh and size < 13) else "admitted"
            live[slot] += want[s, i] == "admitted"
    assert got == want and set(want.values()) == {"over_queues", "over_capacity", "admitted"}


def test_members_are_inflated_in_steps():
    lines = "".join(f"{i}\thttp://site{i % 97}.example/some/path\n" for i in range(400_000)).encode()
    data = gzip.compress(lines)
    tracemalloc.start()
    n = sum(len(part) for start, end, damaged in logs.members(data) for part in logs.lines_of(data, start, end, damaged))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < len(lines) / 2


def test_writers_and_file_names(spark):
    rows = spark.createDataFrame([(1.0, "a\tb", "u\n", 2.5, True), (2.0, "c", "v", 3.0, False)], "dispatch_ts double, slot_id string, url string, monotonic_ts double, accepted boolean")
    assert [r["line"] for r in logs.dispatched_lines(rows).collect()] == ["1.000\ta%09b\tu%0A\t2.500000"]
    assert sorted(r["line"] for r in logs.discovered_lines(rows).collect()) == ["u%0A", "v"]
    names = {"data/runstats.tsv": "0", "/x/runstats-3.tsv": "3", "runstats--12.tsv": "12", "s3://b/other-1.tsv": "other-1"}
    got = spark.createDataFrame([(k,) for k in names], "p string").select("p", logs.shard_of_file(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == names
