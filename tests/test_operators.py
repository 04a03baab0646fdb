import random

import pytest
from pyspark.sql import functions as F

from sparkfrontier.operators import audit, frontier, report, robots, running, seeds


def test_guard_counts_only_accepted_rows(spark):
    rows = [("a", t, i) for i, t in enumerate([0.0, 3.0, 4.0, 5.0, 9.97, 12.0])] + [("b", 0.5, 9)]
    got = audit.guard_replay(spark.createDataFrame(rows, "slot_id string, dispatch_ts double, event_id long"), 5.0).orderBy("event_id").collect()
    assert [r["accepted"] for r in got] == [True, False, False, True, True, False, True]


def test_clock_steps(spark):
    wall, mono = [1000.0, 1005.2, 1008.4, 1013.6], [500.0, 505.2, 510.4, 515.6]
    verdict = lambda ts: audit.politeness_verdict(spark.createDataFrame([("a", t, i) for i, t in enumerate(ts)], "slot_id string, dispatch_ts double, event_id long")).first()
    assert (verdict(mono)["violations"], round(verdict(mono)["min_gap"], 3)) == (0, 5.2)
    assert (verdict(wall)["violations"], round(verdict(wall)["min_gap"], 3)) == (1, 3.2)


def test_limiter_closed_form_is_the_recurrence(spark):
    rng, rows, want = random.Random(3), [], {}
    for slot in range(4):
        free = 0.0
        for seq, arrive in enumerate(sorted(rng.uniform(0, 100) for _ in range(30))):
            rtt = rng.uniform(0, 4)
            start = max(arrive, free)
            free = start + rtt + 2.0
            rows.append((slot, seq, arrive, rtt))
            want[slot, seq] = start
    got = frontier.limiter_schedule(spark.createDataFrame(rows, "slot long, seq long, arrive double, rtt double"), 2.0).collect()
    assert all(abs(r["start"] - want[r["slot"], r["seq"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_domain_curve_against_a_loop(spark, seed):
    rng = random.Random(seed)
    stamps = sorted((rng.choice([rng.uniform(0, 50), rng.uniform(900, 1000)]), f"k{rng.randrange(60)}") for _ in range(200))
    t0, span = stamps[0][0], stamps[-1][0] - stamps[0][0]
    want, seen, mark = [], set(), span / 40
    for t, key in stamps:
        seen.add(key)
        if t - t0 >= mark:
            want.append((mark, len(seen)))
            mark += span / 40
    want.append((span, len(seen)))
    got = report.domain_curve(spark.createDataFrame(stamps, "t double, key string")).orderBy("i").collect()
    assert [r["domains"] for r in got] == [n for _, n in want]
    assert all(abs(r["t"] - t) < 1e-6 for r, (t, _) in zip(got, want, strict=True))


def test_admission_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), i) for i in range(300)]
    queues, cap, ceiling = 20, 60, int(60 * 1.1)
    open_slots, size, seen, want = set(), 0, set(), {}
    for slot, seq in rows:
        new = slot not in seen
        seen.add(slot)
        if len(open_slots) >= queues and slot not in open_slots:
            want[seq] = "over_queues"
        elif size >= cap and not (new and size < ceiling):
            want[seq] = "over_capacity"
        else:
            want[seq], size = "admitted", size + 1
            open_slots.add(slot)
    got = frontier.admission(spark.createDataFrame(rows, "slot long, seq long"), queues, cap).collect()
    assert {r["seq"]: r["verdict"] for r in got} == want


def test_wave_order_is_round_robin(spark):
    rows = [(s, s * 2 + k) for s in range(5) for k in range(2)]
    got = [r["slot"] for r in frontier.wave_order(spark.createDataFrame(rows, "slot long, seq long")).orderBy("position").collect()]
    assert got[:5] == got[5:] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 4, 5, 1000])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(50)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0.0, 0.5, 0.9):
        assert running.upper_index(df, "v", p) == sorted(values)[int(n * p)]
    assert running.upper_index(df.limit(0), "v", 0.5) is None


def test_numbered_is_one_sequence(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(30)), i) for i in range(500)]
    got = running.numbered(spark.createDataFrame(rows, "t double, i long"), "t", ["i"], {"total": F.lit(1)}, parts=7).orderBy("t", "i").collect()
    assert [r["row_index"] for r in got] == [r["total"] for r in got] == list(range(1, 501))


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\nCrawl-delay: 120\n"
    bodies = spark.createDataFrame([("a.example", 200, body), ("b.example", 503, body), ("c.example", 200, "")], "netloc string, status int, body string")
    rules = robots.parse_rules(bodies)
    cases = {"http://a.example/private": False, "http://a.example/public": True, "http://a.example/private/ok/1": True, "http://a.example/x.pdf": False, "http://a.example/x.pdf?y": True, "http://b.example/": False, "http://c.example/any": True, "http://d.example/": False}
    got = robots.decide(spark.createDataFrame([(u,) for u in cases], "url string"), rules).collect()
    assert {r["url"]: r["allowed"] for r in got} == cases
    assert [r[0] for r in rules.where("delay is not null").select(robots.effective_delay(F.col("delay"))).collect()] == [60.0]
    ttl = [r[0] for r in spark.createDataFrame([(n,) for n in [1, 2, 3, 4, 5, 6, 7, 8, 10000, 0]], "n long").select(robots.failure_ttl(F.col("n"))).collect()]
    assert ttl == [300, 600, 1200, 2400, 4800, 9600, 14400, 14400, 14400, 300]


def test_seeds_fill_quotas_and_top_up(spark):
    names = [f"s{i}.com" for i in range(80)] + [f"t{i}.org" for i in range(15)] + ["u.net", "cdn.akamai.net", "www.s1.com"]
    df = spark.createDataFrame([(d, i + 1) for i, d in enumerate(names)], "domain string, rank long")
    got = seeds.select_seeds(df, 20, 200).orderBy("position").collect()
    assert len(got) == 20 and [r["position"] for r in got] == list(range(1, 21))
    assert sum(r["tld"] == "com" for r in got) >= 7 and any(r["tld"] == "net" for r in got)
    assert not any("akamai" in r["domain"] for r in got)
    assert seeds.select_seeds(df.limit(0), 20, 200).count() == 0


def test_shard_load_is_even(spark):
    keys = spark.range(4000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".example")).alias("k"))
    load = [r["keys"] for r in frontier.shard_load(keys, "k", 4).collect()]
    assert len(load) == 4 and max(load) / min(load) <= 1.4
