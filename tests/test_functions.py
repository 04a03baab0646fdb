import pytest
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS, load
from sparkfrontier.functions import domains, links, urls


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "u string").select(column(F.col("u"))).first()[0]


@pytest.mark.parametrize("port", ["void(0)", "javascript", "80x", "-1", "{{port}}"])
def test_bad_ports_are_rejected(spark, port):
    assert one(spark, f"http://host:{port}/", urls.reject_reason) in ("port", "host")
    assert urls.normalize(f"http://host:{port}/", "http://x.example/") is None


@pytest.mark.parametrize("url", ["https://a.example:8080/", "https://a.example:443/x", "https://a.example/", "https://a.example:/"])
def test_good_ports_pass(spark, url):
    assert one(spark, url, urls.accepts) is True


def test_parts(spark):
    u = "HTTP://user@Host.Example:81/a/b.PDF?x=1&SID=2#f"
    assert one(spark, u, urls.host) == "host.example"
    assert one(spark, u, urls.port) == "81"
    assert one(spark, u, urls.extension) == "pdf"
    assert one(spark, "http://[::1]:8/", urls.host) == "::1"
    assert one(spark, "http://[::1]:8/", urls.port) == "8"
    assert one(spark, u, urls.without_fragment).endswith("SID=2")


def test_normalize_collapses_and_is_idempotent():
    a = urls.normalize("/a?b=2&a=1", "https://Site.example/x")
    assert a == urls.normalize("https://site.example/a?a=1&b=2#frag", "https://other.example/") == "https://site.example/a?a=1&b=2"
    for href in ["..//x y", "?q=ü", "//cdn.example/p", "%7e/a", "a;b=1?c", "/é/%zz", "http://h.example"]:
        u = urls.normalize(href, "https://site.example/d/e")
        assert urls.normalize(u, "https://ignored.example/") == u
    for href in ["", "  ", "#top", "javascript:x()", "mailto:a@b", "tel:1", "data:x", None]:
        assert urls.normalize(href, "https://site.example/") is None
    assert urls.normalize("http://h.example", "x") == "http://h.example/"
    assert urls.normalize("https://h.example/a/../b", "x") == "https://h.example/a/../b"


def test_slots_and_shards(spark):
    cases = {
        "https://a.b.example.com/x": "example.com", "https://www.shop.co.uk/": "shop.co.uk", "https://me.blogspot.com/": "me.blogspot.com",
        "https://10.0.0.1/": "10.0.0.1", "https://[2001:db8::1]/": "2001:db8::1", "nohost": "__nohost__", "https://localhost/": "localhost", "https://co.uk/": "co.uk",
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", domains.slot_key(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["s"] for r in got} == cases
    import hashlib

    keys = [f"d{i}.example" for i in range(50)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", domains.shard_of(F.col("k"), 7).alias("s")).collect()
    assert all(r["s"] == int.from_bytes(hashlib.md5(r["k"].encode()).digest()[:8], "big") % 7 for r in got)


def test_hrefs_base_and_charset(spark):
    html = """<meta charset='utf-8'><base target=x href="https://base.example/d/"><a href="a">1</a><A class=x HREF = ' b '>2</A><a href=c>3</a><a href="">4</a><abbr href="no">"""
    row = spark.createDataFrame([(html,)], "h string").select(links.hrefs(F.col("h")), links.base_href(F.col("h")), links.charset(F.col("h"))).first()
    assert list(row) == [["a", "b", "c"], "https://base.example/d/", "utf-8"]
    page = spark.createDataFrame([(1, "https://p.example/", html + "<a href='https://o.example:80x/'><a href=c#f>")], "page_id long, url string, html string")
    assert sorted(r["link"] for r in links.page_links(page).collect()) == [f"https://base.example/d/{x}" for x in "abc"]


def test_config_from_toml(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[politeness]\nmin_gap = 7.5\nunknown = 1\n[filters]\nskip_query_keys = ["x"]\n')
    s = load(f)
    assert (s.min_gap, s.skip_query_keys, s.max_path_depth) == (7.5, ("x",), DEFAULTS.max_path_depth)
