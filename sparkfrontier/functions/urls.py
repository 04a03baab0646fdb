"""URLs: parts, filters and fingerprints as column expressions; joining and canonical form as an Arrow UDF."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes, urlencode, urljoin, urlparse, urlsplit, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkfrontier.config import DEFAULTS, Settings

#: scheme, authority, path, query, fragment of any URL reference (RFC 3986, appendix B).
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Host in lower case, without user information and port; an IPv6 literal without its brackets."""
    bare = F.regexp_replace(netloc(url), "^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", "")))


def port(url: Column) -> Column:
    """What follows the host's colon, empty if nothing does."""
    return F.regexp_extract(netloc(url), r"(?:\]|^[^\[]*?):([^:\]@]*)$", 1)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def good_port(url: Column) -> Column:
    p = port(url)
    return (p == "") | (p.rlike("^[0-9]{1,5}$") & (p.try_cast("int") <= 65535))


def params(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda x: x != "")


def extension(url: Column) -> Column:
    """Lower-case extension of the last path segment, empty if it has none."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.when(last.contains("."), F.lower(F.substring_index(last, ".", -1))).otherwise("")


def reject_reason(url: Column, s: Settings = DEFAULTS) -> Column:
    """Why a URL isn't followed; null if it is. Rules in order: scheme, host, port, length, extension, depth, params, session."""
    key = lambda x: F.lower(F.substring_index(x, "=", 1))
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(host(url) == "", "host")
        .when(~good_port(url), "port")
        .when(F.char_length(url) > s.max_url_length, "length")
        .when(extension(url).isin(*s.skip_extensions), "extension")
        .when(F.char_length(path(url)) - F.char_length(F.replace(path(url), F.lit("/"))) > s.max_path_depth, "depth")
        .when(F.size(params(url)) > s.max_query_params, "params")
        .when(F.exists(params(url), lambda x: key(x).isin(*s.skip_query_keys)), "session")
    )


def accepts(url: Column, s: Settings = DEFAULTS) -> Column:
    return reject_reason(url, s).isNull()


def _json_text(text: Column) -> Column:
    """A text as JSON writes it in ASCII, without the quotes around it."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.hex(F.encode(quoted, "UTF-16BE"))
    unit = lambda i: F.substring(units, (i * 4 + 1).cast("int"), F.lit(4))
    sign = lambda u: F.when((u >= "0020") & (u < "0080"), F.char(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
    escaped = F.array_join(F.transform(F.sequence(F.lit(0), (F.char_length(units) / 4).cast("int") - 1), lambda i: sign(unit(i))), "")
    return F.when(quoted.rlike(r"[^\x20-\x7F]"), escaped).otherwise(quoted)


def fingerprint(url: Column) -> Column:
    """SHA-1 of a GET request for the URL, as JSON with sorted keys and ASCII escapes."""
    return F.sha1(F.concat(F.lit('{"body": "", "headers": {}, "method": "GET", "url": "'), _json_text(url), F.lit('"}')))


def hash128(url: Column) -> Column:
    """The first 16 bytes of the fingerprint, big-endian: what a filter of 128-bit keys holds."""
    return F.unhex(F.substring(fingerprint(url), 1, 32))


_SCHEME = re.compile(r"^([^:/]+):")
# Signs that stay in a path, and in what follows a semicolon.
_PATH_SAFE = ":/?[]@!$&'()*+,;=-._~%"
_PARAMS_SAFE = _PATH_SAFE + "#"
#: Escaped slashes and question marks keep their escapes, as they would end the path otherwise.
_KEPT = re.compile(r"%(2f|3f)", re.IGNORECASE)


def _authority(netloc: str) -> str:
    """Host in lower case and in its ASCII form, without an empty port; user information as it is."""
    user, at, rest = netloc.rpartition("@")
    if not rest.isascii():
        name, colon, port = rest.partition(":")
        try:
            rest = name.encode("idna").decode() + colon + port
        except UnicodeError:
            pass
    return user + at + rest.lower().rstrip(":")


def canonical(url: str) -> str:
    """The form that equal requests share: pairs of the query decoded as forms are, sorted and encoded again, blanks kept;
    escapes of the path taken back where they aren't needed, upper-case where they are; `/` for an empty path; no fragment.

    Dot segments and default ports stay.
    """
    p = urlparse(url)
    pairs = [pair.partition("=") for part in p.query.split("&") for pair in part.split(";") if pair]
    plain = lambda text: unquote_to_bytes(text.replace("+", " "))
    query = urlencode(sorted((plain(k), plain(v)) for k, _, v in pairs))
    path = quote(unquote_to_bytes(_KEPT.sub(lambda m: "%25" + m.group(1).upper(), p.path)), safe=_PATH_SAFE)
    return urlunparse((p.scheme.lower(), _authority(p.netloc), path or "/", quote(p.params, safe=_PARAMS_SAFE), query, ""))


def normalize(href: str | None, base: str | None) -> str | None:
    """The absolute canonical URL of a link on a page, or None if it can't be followed; no filter rules."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return None
    if ":" in href[:12] and (m := _SCHEME.match(href)) and m.group(1).lower() not in ("http", "https"):
        return None
    try:
        absolute = urljoin(base or "", href)
        p = urlsplit(absolute)
        if p.scheme.lower() not in ("http", "https") or not p.hostname:
            return None
        _ = p.port  # a malformed port raises here
        return canonical(absolute.split("#", 1)[0])
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(StringType())
def normalized(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalize(h, b) for h, b in zip(href, base, strict=True)], dtype=object)
