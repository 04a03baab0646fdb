"""Queries: links, URLs, domains, robots, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfrontier.functions import domains, links, urls
from sparkfrontier.operators import robots, seeds
from sparkfrontier.sources import relations as r


def _pages(spark, sf_dir):
    return r.table(spark, sf_dir, "pages")


def page_hrefs(spark, sf_dir):
    return links.page_hrefs(_pages(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def page_link_counts(spark, sf_dir):
    return links.page_hrefs(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("different"))


def links_topk(spark, sf_dir):
    return links.page_hrefs(_pages(spark, sf_dir)).groupBy("href").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "href").limit(20)


def declarations(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.groupBy(links.charset(F.col("html")).alias("charset"), links.base_href(F.col("html")).alias("base")).agg(F.count("*").alias("n"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.port(u).alias("port"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.without_fragment(u).alias("plain"), urls.origin(u).alias("origin"))


def _hard_urls(spark, sf_dir):
    """Page URLs made hard to accept in turn: ports, extensions, depth, parameters, sessions."""
    u, i = urls.without_fragment(F.col("url")), F.col("page_id") % 9
    base = F.substring_index(u, "?", 1)
    made = (
        F.when(i == 0, F.concat(base, F.lit("/file.PDF"))).when(i == 1, F.concat(base, F.lit("/a/b/c/d/e/f/g/h"))).when(i == 2, F.concat(base, F.lit("?a=1&b=2&c=3&d=4&e=5&f=6")))
        .when(i == 3, F.concat(base, F.lit("?x=1&SID=9"))).when(i == 4, F.concat(urls.scheme(u), F.lit("://"), urls.host(u), F.lit(":80x/"))).when(i == 5, F.concat(urls.scheme(u), F.lit("://"), urls.host(u), F.lit(":8080/ok")))
        .when(i == 6, F.concat(F.lit("ftp://"), urls.host(u), F.lit("/"))).when(i == 7, F.concat(base, F.lit("/"), F.repeat(F.lit("x"), 2100))).otherwise(u)
    )
    return _pages(spark, sf_dir).select("page_id", made.alias("url"))


def url_accepts(spark, sf_dir):
    return _hard_urls(spark, sf_dir).select("page_id", urls.accepts(F.col("url")).alias("accepted"))


def url_reject_reasons(spark, sf_dir):
    return _hard_urls(spark, sf_dir).groupBy(F.coalesce(urls.reject_reason(F.col("url")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def html_types(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ["text/html", "TEXT/HTML; charset=x", "application/xhtml+xml", "", "image/png", "application/json"])), (F.col("page_id") % 6 + 1).cast("int"))
    return _pages(spark, sf_dir).select(kinds.alias("content_type")).groupBy("content_type").agg(F.count("*").alias("n")).withColumn("is_html", links.is_html(F.col("content_type")))


def slot_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(domains.slot_key(F.col("url")).alias("slot")).agg(F.count("*").alias("pages"), F.count_distinct(urls.host(F.col("url"))).alias("hosts"))


def origin_topk(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin").limit(40)


def normalize_urls(spark, sf_dir):
    return links.page_links(_pages(spark, sf_dir)).select("page_id", "url", "link", F.col("pos").cast("long").alias("pos"))


def probe_link_counts(spark, sf_dir):
    """What a probe of a page counts: its different canonical links."""
    return links.normalized_links(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("links"))


#: Rules that the registered_domains query works with: the fixed names, some top-level ones, a wildcard and its exception.
PUBLIC_RULES = [*domains.SUFFIXES, "com", "net", "org", "de", "uk", "*.ck", "!www.ck"]


def registered_domains(spark, sf_dir):
    """Hosts of pages and made ones under each kind of rule, by registered domain."""
    rules = spark.createDataFrame([(x,) for x in PUBLIC_RULES], "rule string")
    i = F.col("page_id") % 6
    end = F.when(i == 0, ".co.uk").when(i == 1, ".a.ck").when(i == 2, ".www.ck").when(i == 3, ".github.io").when(i == 4, ".intranet").otherwise("")
    hosts = _pages(spark, sf_dir).select(F.concat(urls.host(F.col("url")), end).alias("host"))
    return domains.registered(hosts, rules).groupBy("slot").agg(F.count("*").alias("n"))


def _rules(spark, sf_dir):
    """A robots.txt for two sites in three; the others' can't be read."""
    sites = _pages(spark, sf_dir).select(F.lower(urls.netloc(F.col("url"))).alias("netloc")).distinct()
    body = F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?page=\nDisallow: /fr/9$\nCrawl-delay: 10\n")
    return robots.parse_rules(sites.select("netloc", F.when(F.char_length("netloc") % 3 == 0, 503).otherwise(200).alias("status"), body.alias("body")), agent="frontier")


def _plain(spark, sf_dir):
    return _pages(spark, sf_dir).select(urls.without_fragment(F.col("url")).alias("url")).distinct()


def robots_decision(spark, sf_dir):
    return robots.decide(_plain(spark, sf_dir), _rules(spark, sf_dir)).select("url", "allowed")


def robots_audit(spark, sf_dir):
    return robots.audit(_plain(spark, sf_dir), _rules(spark, sf_dir), 40)


def robots_backoff(spark, sf_dir):
    return spark.range(0, 41).select(F.col("id").alias("failures"), robots.failure_ttl(F.col("id")).alias("ttl"))


def crawl_delay(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", robots.effective_delay(F.when(F.col("page_id") % 5 > 0, (F.col("page_id") % 100).cast("double"))).alias("delay"))


def _candidates(spark, sf_dir):
    """Customers as ranked domains over some top-level domains, some of infrastructure, some under one registered domain."""
    key = F.col("c_custkey")
    name = F.when(key % 17 == 0, F.concat(F.lit("cdn.akamai"), key.cast("string"))).when(key % 11 == 0, F.lit("www.shared")).otherwise(F.concat(F.lit("site"), key.cast("string")))
    end = F.element_at(F.array(*map(F.lit, ["com", "com", "com", "org", "net", "co.uk", "de"])), (key % 7 + 1).cast("int"))
    return r.table(spark, sf_dir, "customer").select(F.concat(name, F.lit("."), end).alias("domain"), key.alias("rank"))


def seed_infra_filter(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy(seeds.is_infrastructure(F.col("domain")).alias("infrastructure")).agg(F.count("*").alias("n"))


def seed_first_per_domain(spark, sf_dir):
    return seeds.one_per_registered(_candidates(spark, sf_dir)).select("slot", "domain", "rank")


def seed_tld_quota(spark, sf_dir):
    return seeds.select_seeds(_candidates(spark, sf_dir), 100, 1000).select("domain", "rank", "tld", F.col("position").cast("long").alias("position"))


def seed_tld_histogram(spark, sf_dir):
    return seeds.select_seeds(_candidates(spark, sf_dir), 100, 1000).groupBy("tld").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tld").limit(10)


def _probes(spark, sf_dir):
    found = links.page_hrefs(_pages(spark, sf_dir)).groupBy("page_id").agg((F.count_distinct("href") % 8).alias("links"))
    note = F.when(F.col("page_id") % 7 == 0, "timeout").when(F.col("page_id") % 5 == 0, "not html").otherwise("ok")
    return _pages(spark, sf_dir).select("page_id", "url").join(found, "page_id").select("url", F.col("page_id").alias("rank"), F.when(note == "ok", F.col("links")).otherwise(0).alias("links"), note.alias("note"))


def seed_probe_filter(spark, sf_dir):
    return seeds.probed(_probes(spark, sf_dir), 50).select("url", "rank", "links")


def seed_probe_rejects(spark, sf_dir):
    return seeds.reject_notes(_probes(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        page_hrefs, page_link_counts, links_topk, declarations, url_parts, url_accepts, url_reject_reasons, html_types, slot_counts, origin_topk, normalize_urls, probe_link_counts, registered_domains, robots_decision,
        robots_audit, robots_backoff, crawl_delay, seed_infra_filter, seed_first_per_domain, seed_tld_quota, seed_tld_histogram, seed_probe_filter, seed_probe_rejects,
    )
}

_H = r"""h AS (SELECT page_id, url, unnest(hs) AS raw, unnest(range(0, len(hs))) AS pos FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]+"|''[^'']+''|[^\s"''<>`]+)', 1) AS hs FROM pages)),
k AS (SELECT page_id, url, pos, trim(raw, '"''') AS href FROM h)"""
# The pages' links are paths; what stands unescaped in them are letters, digits, and the signs that are put back.
_LINKS = rf"""{_H}, ln AS (SELECT page_id, url, pos, href, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) || replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3A', ':'), '%3B', ';') AS link FROM k WHERE href <> '')"""
_P = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\?([^#]*))?', ['scheme', 'netloc', 'path', 'q', 'query']) AS x FROM pages)"""
_HARD = r"""w AS (SELECT page_id, page_id % 9 AS i, split_part(url, '#', 1) AS u, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
v AS (SELECT CASE i WHEN 0 THEN 'extension' WHEN 1 THEN CASE WHEN len(regexp_replace(split_part(split_part(u, '://', 2), '?', 1), '[^/]', '', 'g')) + 8 > 8 THEN 'depth' END WHEN 2 THEN 'params' WHEN 3 THEN 'session' WHEN 4 THEN 'port' WHEN 6 THEN 'scheme' WHEN 7 THEN 'length' END AS reason, page_id FROM w)"""
_R = r"""q AS (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages),
s AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS target FROM q),
d AS (SELECT url, site, len(site) % 3 <> 0 AS readable, CASE WHEN target LIKE '/en/1%' AND NOT (regexp_matches(target, '^/.*[?]page=') AND 8 > 5) THEN true
  WHEN regexp_matches(target, '^/.*[?]page=') THEN false WHEN target LIKE '/en/%' THEN false WHEN target = '/fr/9' THEN false ELSE true END AS ok FROM s)"""
_CAND = """c0 AS (SELECT c_custkey AS rank, CASE WHEN c_custkey % 17 = 0 THEN 'cdn.akamai' || c_custkey WHEN c_custkey % 11 = 0 THEN 'www.shared' ELSE 'site' || c_custkey END AS name,
  (['com', 'com', 'com', 'org', 'net', 'co.uk', 'de'])[c_custkey % 7 + 1] AS suffix FROM customer),
c1 AS (SELECT rank, name || '.' || suffix AS domain, name LIKE '%akamai%' AS infra, split_part(name, '.', -1) || '.' || suffix AS slot, split_part(suffix, '.', -1) AS tld FROM c0),
one AS (SELECT slot, arg_min(domain, rank) AS domain, min(rank) AS rank, arg_min(tld, rank) AS tld FROM c1 WHERE NOT infra AND rank <= {0} GROUP BY slot)"""
_QUOTA = f"""{_CAND.format(1000)}, z AS (SELECT tld, count(*) AS size, min(rank) AS best, sum(count(*)) OVER () AS total FROM one GROUP BY tld),
y AS (SELECT *, row_number() OVER (ORDER BY size DESC, best) AS place, least(35, greatest(1, round_even(100 * size / total, 0)), size)::BIGINT AS quota FROM z),
x AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(quota) OVER () AS allq FROM y),
n AS (SELECT one.*, row_number() OVER (PARTITION BY one.tld ORDER BY rank) AS nth, place, quota, before, allq FROM one JOIN x USING (tld)),
t AS (SELECT domain, rank, tld, before + nth AS position FROM n WHERE nth <= quota
  UNION ALL SELECT domain, rank, tld, allq + row_number() OVER (ORDER BY nth - quota, place) FROM n WHERE nth > quota),
picked AS (SELECT domain, rank, tld, position::BIGINT AS position FROM t WHERE position <= 100)"""
_PROBE = f"""{_H}, f AS (SELECT page_id, count(DISTINCT href) % 8 AS links FROM k WHERE href <> '' GROUP BY 1),
pr AS (SELECT url, page_id AS rank, CASE WHEN page_id % 7 = 0 THEN 'timeout' WHEN page_id % 5 = 0 THEN 'not html' ELSE 'ok' END AS note, links FROM pages JOIN f USING (page_id))"""
_PUBLIC = f"""rules AS (SELECT unnest({PUBLIC_RULES!r}) AS rule),
ho AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || (['.co.uk', '.a.ck', '.www.ck', '.github.io', '.intranet', ''])[page_id % 6 + 1] AS host FROM pages),
tl AS (SELECT host, string_split(host, '.') AS ls, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM (SELECT DISTINCT host FROM ho)),
tr AS (SELECT host, ls, k, array_to_string(ls[len(ls) - k + 1 :], '.') AS tail, array_to_string(ls[len(ls) - k + 2 :], '.') AS shorter FROM tl),
hit AS (SELECT host, ls, CASE WHEN '!' || tail IN (SELECT rule FROM rules) THEN 1000 + k - 1 WHEN tail IN (SELECT rule FROM rules) OR k > 1 AND '*.' || shorter IN (SELECT rule FROM rules) THEN k END AS public FROM tr),
best AS (SELECT host, ls, max(public) % 1000 AS public FROM hit GROUP BY host, ls),
so AS (SELECT host, CASE WHEN public IS NULL OR len(ls) <= public THEN host ELSE array_to_string(ls[len(ls) - public :], '.') END AS slot FROM best)"""
ORACLE_SQL = {
    "normalize_urls": f"WITH {_LINKS} SELECT page_id, url, link, min(pos) AS pos FROM ln GROUP BY 1, 2, 3",
    "probe_link_counts": f"WITH {_LINKS} SELECT page_id, count(DISTINCT link) AS links FROM ln GROUP BY 1",
    "registered_domains": f"WITH {_PUBLIC} SELECT slot, count(*) AS n FROM ho JOIN so USING (host) GROUP BY slot",
    "page_hrefs": f"WITH {_H} SELECT page_id, pos, href FROM k WHERE href <> ''",
    "page_link_counts": f"WITH {_H} SELECT page_id, count(*) AS links, count(DISTINCT href) AS different FROM k WHERE href <> '' GROUP BY 1",
    "links_topk": f"WITH {_H} SELECT href, count(*) AS n FROM k WHERE href <> '' GROUP BY 1 ORDER BY n DESC, href LIMIT 20",
    "declarations": r"""SELECT nullif(regexp_extract(substr(html, 1, 4096), '(?i)charset\s*=\s*["'']?([A-Za-z0-9_\-]{2,40})', 1), '') AS charset, nullif(regexp_extract(html, '(?i)<base\s[^>]*?href\s*=\s*"([^"]+)"', 1), '') AS base, count(*) AS n FROM pages GROUP BY 1, 2""",
    "url_parts": f"WITH {_P} SELECT page_id, x.scheme AS scheme, lower(x.netloc) AS host, '' AS port, x.path AS path, x.query AS query, split_part(url, '#', 1) AS plain, x.scheme || '://' || x.netloc AS origin FROM p",
    "url_accepts": f"WITH {_HARD} SELECT page_id, reason IS NULL AS accepted FROM v",
    "url_reject_reasons": f"WITH {_HARD} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM v GROUP BY 1",
    "html_types": """SELECT (['text/html', 'TEXT/HTML; charset=x', 'application/xhtml+xml', '', 'image/png', 'application/json'])[page_id % 6 + 1] AS content_type, count(*) AS n, page_id % 6 < 4 AS is_html FROM pages GROUP BY 1, 3""",
    "slot_counts": f"WITH {_P} SELECT regexp_extract(x.netloc, '([^.]+[.][^.]+)$', 1) AS slot, count(*) AS pages, count(DISTINCT x.netloc) AS hosts FROM p GROUP BY 1",
    "origin_topk": f"WITH {_P} SELECT x.scheme || '://' || x.netloc AS origin, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, origin LIMIT 40",
    "robots_decision": f"WITH {_R} SELECT url, readable AND ok AS allowed FROM d",
    "robots_audit": f"""WITH {_R}, t AS (SELECT site, count(*) AS urls, any_value(readable) AS readable, count(*) FILTER (readable AND NOT ok) AS violations FROM d GROUP BY 1)
SELECT site, urls, readable, violations FROM t ORDER BY urls DESC, site LIMIT 40""",
    "robots_backoff": "SELECT i AS failures, least(300.0 * 2.0 ** least(greatest(i - 1, 0), 32), 14400.0)::DOUBLE AS ttl FROM range(0, 41) r(i)",
    "crawl_delay": "SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 100 <= 5.1 THEN 5.1 ELSE least(page_id % 100, 60) END::DOUBLE AS delay FROM pages",
    "seed_infra_filter": f"WITH {_CAND.format(1000000000)} SELECT infra AS infrastructure, count(*) AS n FROM c1 GROUP BY 1",
    "seed_first_per_domain": f"WITH {_CAND.format(1000000000)} SELECT slot, domain, rank FROM one",
    "seed_tld_quota": f"WITH {_QUOTA} SELECT * FROM picked",
    "seed_tld_histogram": f"WITH {_QUOTA} SELECT tld, count(*) AS n FROM picked GROUP BY 1 ORDER BY n DESC, tld LIMIT 10",
    "seed_probe_filter": f"WITH {_PROBE} SELECT url, rank, links FROM pr WHERE note = 'ok' AND links >= 5 ORDER BY rank LIMIT 50",
    "seed_probe_rejects": f"WITH {_PROBE} SELECT note, count(*) AS n FROM pr WHERE note <> 'ok' OR links < 5 GROUP BY 1 ORDER BY n DESC, note LIMIT 6",
}
