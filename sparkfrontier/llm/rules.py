"""Quality rules: base statistics of a text, and cross-document line frequency within a host.

Lines are normalised and hashed, the different documents of a host that hold a line are counted, lines above the limit
count as boilerplate, and a document that is mostly boilerplate is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, small, stage_out, table, text_id, word_count, words

SYMBOLS = "[#*$%&|<>]"

#: A line is boilerplate if more than max(LIMIT_DOCS, LIMIT_SHARE * texts) different texts of its host hold it.
LIMIT_DOCS, LIMIT_SHARE = 10, 0.01
#: A document is depleted if more than this share of its words stands in boilerplate lines.
DEPLETED = 0.5
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed, digits as 0."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"[\x09-\x0D][\x20\x09-\x0D]*| [\x20\x09-\x0D]+", " "), "[1-9]", "0")))


def base_statistics(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text column, all long; null is empty.

    Words of repeated 3-word windows: hash and start share a long, so that one primitive sort brings equal windows
    together; neighbours are compared by their full hash.
    """
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("_l", _lines(F.col("_t"))).withColumn("_n", F.size("_w"))
    df = df.withColumn("_h", F.expr("case when _n >= 4 then transform(sequence(0, _n - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) else cast(array() as array<bigint>) end"))
    df = df.withColumn("_b", F.expr("cast(ceil(log2(_n + 1)) as int)"))
    df = df.withColumn("_k", F.expr("sort_array(transform(_h, (h, i) -> shiftleft(h, _b) | i))"))
    df = df.withColumn("_p", F.expr("transform(_k, k -> cast(k & (shiftleft(1L, _b) - 1) as int))"))
    df = df.withColumn("_q", F.expr("transform(_p, p -> _h[p])"))
    df = df.withColumn("_d", F.expr("sort_array(filter(_p, (p, j) -> (j > 0 and _q[j] = _q[j - 1]) or (j + 1 < size(_q) and _q[j] = _q[j + 1])))"))
    repeat = F.expr("aggregate(_d, named_struct('end', 0, 'n', 0L), (a, p) -> named_struct('end', p + 3, 'n', a.n + 3 - greatest(0, a.end - p)), a -> a.n)")
    out = {
        "n_words": F.col("_n"),
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeat,
    }
    return df.withColumns({k: v.cast("long") for k, v in out.items()}).drop("_t", "_w", "_l", "_n", "_h", "_b", "_k", "_p", "_q", "_d")


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, text_hash, gone): hashes of the boilerplate lines, for each different text of a host that has any."""
    line = F.array_distinct(F.transform(F.transform(_lines(F.col(text_col)), normal_line), lambda x: F.xxhash64(x)))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("host"), text_id(F.col(text_col)).alias("text_hash"), line.alias("lines")).where(F.size("lines") > 0)
    # equal texts count once, and are dropped before anything is exploded
    texts = texts.dropDuplicates(["host", "text_hash"])
    texts = stage_out(texts, "rules-lines")
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    held = texts.select("host", F.explode("lines").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    held = held.where(F.col("n") > LIMIT_DOCS).join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    frequent = stage_out(held.where(F.col("n") > F.greatest(F.lit(float(LIMIT_DOCS)), F.lit(LIMIT_SHARE) * F.col("texts"))).select(F.col("host").alias("host_"), F.col("h").alias("h_")), "rules-frequent")
    each = texts.select("host", "text_hash", F.explode("lines").alias("h"))
    hit = each.join(small(frequent), (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_")))
    return hit.groupBy("host", "text_hash").agg(F.collect_set("h").alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normal form has a hash in `gone`; blank lines stay."""
    held = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(gone, F.xxhash64(normal_line(x)))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(held, "\n"))


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs (or its columns in `keep`) with the base statistics, clean_text, removed_words, base_failed and kept.

    clean_text is the text without its boilerplate lines, removed_words the words that it lacks.

    A null or empty text has no words and fails the base rules. A null host is a host of its own. Equal texts of a host
    count as one document of it, so copies and repeated rows don't make each other's lines boilerplate, and share their
    verdict. Texts are read whole, however long; a line at the limit stays. Input
    columns named like an added one are replaced. An empty table gives an empty result.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "removed_words", "base_failed", "kept"}
    kept = [c for c in only(docs, keep) if c.lower() not in added]
    base = base_statistics(docs.select(packed(kept).alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("body")), "body")
    base = base.withColumn("text_hash", text_id(F.col("body")))
    found = boilerplate_lines(docs, text_col, host_col).select(F.col("host").alias("host_"), F.col("text_hash").alias("hash_"), "gone")
    out = base.join(found, (F.col("text_hash") == F.col("hash_")) & F.col("host").eqNullSafe(F.col("host_")), "left")
    out = out.withColumn("clean_text", without_lines(F.col("body"), F.col("gone")))
    out = out.withColumn("removed_words", F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_words") - word_count(F.col("clean_text"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        *[f"row.`{c}`" for c in kept], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "clean_text", "removed_words", failed.alias("base_failed"), (~failed & (F.col("removed_words") <= F.lit(DEPLETED) * F.col("n_words"))).alias("kept"),
    )


def op6_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("clean_text")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {
    "op6_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
lines AS (SELECT DISTINCT source, t, k, l FROM (SELECT source, t, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS l FROM w)),
norm AS (SELECT source, t, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
                lower(trim(regexp_replace(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS l FROM lines),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM w WHERE len(ls) > 0 GROUP BY source),
freq AS (SELECT n.source, l FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source
         GROUP BY n.source, l HAVING count(DISTINCT t) > greatest(10.0, 0.01 * max(texts))),
gone AS (SELECT n.source, t, sum(n)::BIGINT AS removed FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.l = f.l GROUP BY n.source, t),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                coalesce(removed, 0)::BIGINT AS removed_words
         FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN gone ON w.source IS NOT DISTINCT FROM gone.source AND w.t = gone.t)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept FROM base"""
}
