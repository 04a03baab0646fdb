"""Links of pages: hrefs in document order, base and charset declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.functions.urls import accepts, normalized

#: Bytes of a value, and of the page's head that declarations are looked for in.
VALUE_LENGTH, BASE_WITHIN, CHARSET_WITHIN = 2048, 8192, 4096

# Three small expressions: where an anchor opens, how its tag leads to the attribute, and the attribute's value, which is
# quoted by either sign (group 1, its content group 2) or bare (group 3).
_ANCHOR = r"(?i)<a(?=\s)"
_TO_HREF = r"[^>]*?href\s*=\s*"
_QUOTED = rf"""(["'])((?:(?!\1).){{1,{VALUE_LENGTH}}})\1"""
_BARE = rf"""([^\s"'`<>]{{1,{VALUE_LENGTH}}})"""
_LINK = rf"(?is)^\s{_TO_HREF}(?:{_QUOTED}|{_BARE})"
_BASE = rf"(?i)<base\s{_TO_HREF}(?s:{_QUOTED})"
_CHARSET = r"(?i)charset\s*=\s*[\"']?([\w-]{2,40})"


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def hrefs(html: Column) -> Column:
    """Non-empty href values of <a> tags, in document order, repeats included.

    The page is split where anchors open, and each piece is read from its start; an anchor written inside an attribute's
    value opens a piece as well.
    """
    tags = F.filter(F.split(html, _ANCHOR, -1), lambda x, i: i > 0)
    value = lambda tag: F.concat(F.regexp_extract(tag, _LINK, 2), F.regexp_extract(tag, _LINK, 3))
    return F.filter(F.coalesce(F.transform(tags, lambda tag: strip(value(tag))), F.array().cast("array<string>")), lambda x: x != "")


def base_href(html: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(html, 1, BASE_WITHIN), _BASE, 2), F.lit(""))


def charset(html: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(html, 1, CHARSET_WITHIN), _CHARSET, 1), F.lit(""))


def is_html(content_type: Column) -> Column:
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return (c == "") | c.contains("text/html") | c.contains("application/xhtml")


def page_hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of every link; pos counts from 0."""
    return pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def normalized_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, pos) of the different canonical links of a page, at their first position; no filter rules."""
    based = pages.select("page_id", "url", F.coalesce(base_href(F.col("html")), F.col("url")).alias("base"), F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    first = based.groupBy("page_id", "url", "base", "href").agg(F.min("pos").alias("pos"))  # a page's repeats are joined once
    # the generator keeps the filter above the function, which would else be evaluated for both
    linked = first.select("page_id", "url", "pos", F.explode(F.array(normalized("href", "base"))).alias("link")).where(F.col("link").isNotNull())
    return linked.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))


def page_links(pages: DataFrame) -> DataFrame:
    """The normalized links of a page that the filter rules accept."""
    return normalized_links(pages).where(accepts(F.col("link")))
