"""robots.txt: bodies to rules, decisions on URLs, audits, back-off and crawl delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.config import DEFAULTS
from sparkfrontier.functions.urls import netloc, part


def parse_rules(bodies: DataFrame, agent: str = "*") -> DataFrame:
    """(netloc, status, body) -> (netloc, allow, pattern, delay) of the agent's group, or of `*`; one row per rule.

    Bodies of another status than 200 give no row; read bodies without rules give one that allows everything.
    Consecutive user-agent lines share a group. The first robots_body_bytes count.
    """
    lines = bodies.where("status = 200").select("netloc", F.posexplode(F.split(F.substring("body", 1, DEFAULTS.robots_body_bytes), r"\r\n|\r|\n")).alias("pos", "line"))
    bare = F.trim(F.substring_index("line", "#", 1))
    lines = lines.select("netloc", "pos", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("key"), F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("netloc").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("grp", F.sum(opens.cast("int")).over(order))
    named = lines.where("key = 'user-agent'").withColumn("mine", F.when(F.lower("value") == agent.lower(), 2).when(F.col("value") == "*", 1).otherwise(0)).where("mine > 0")
    best = named.withColumn("top", F.max("mine").over(Window.partitionBy("netloc"))).where("mine = top").select("netloc", "grp").distinct()
    rules = lines.where("key <> 'user-agent'").join(best, ["netloc", "grp"])
    rules = rules.select("netloc", F.when(F.col("key") != "crawl-delay", F.col("key") == "allow").alias("allow"), F.when(F.col("key") != "crawl-delay", F.col("value")).alias("pattern"), F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double")).alias("delay"))
    rules = rules.where("delay is not null or pattern <> ''")
    readable = bodies.where("status = 200").select("netloc").distinct()
    return rules.unionByName(readable.select("netloc", F.lit(True).alias("allow"), F.lit("").alias("pattern"), F.lit(None).cast("double").alias("delay")))


def pattern_regex(pattern: Column) -> Column:
    """A rule's path pattern as a regular expression: `*` is any text, a final `$` the end."""
    escaped = F.regexp_replace(pattern, r"([\\.^|?+()\[\]{}])", r"\\$1")
    escaped = F.regexp_replace(escaped, r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")))


def decide(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed: the longest matching pattern wins, allow on ties; a site without readable rules is refused.

    urls must be different; the table of rules joins by site, so no site's rules have to fit a task.
    """
    rule = rules.where("pattern is not null").select(F.col("netloc").alias("site"), "allow", "pattern", pattern_regex(F.col("pattern")).alias("rx"))
    target = F.concat(F.when(part(F.col(url), 3) == "", "/").otherwise(part(F.col(url), 3)), F.when(part(F.col(url), 4) != "", F.concat(F.lit("?"), part(F.col(url), 4))).otherwise(""))
    sited = urls.withColumn("site", F.lower(netloc(F.col(url)))).withColumn("target", target)
    hit = sited.join(rule, "site", "left").where(F.col("rx").isNull() | F.expr("target rlike rx"))
    best = hit.groupBy(url).agg(F.max_by(F.col("allow"), F.struct(F.char_length("pattern"), F.col("allow"))).alias("allow"))
    return urls.join(best, url, "left").withColumn("allowed", F.coalesce("allow", F.lit(False))).drop("allow")


def audit(fetched: DataFrame, rules: DataFrame, top: int = 40) -> DataFrame:
    """Per site of the `top` sites by fetched URLs: urls and how many the rules refuse; sites without rules are skipped and marked."""
    sited = fetched.select("url").distinct().withColumn("site", F.lower(netloc(F.col("url"))))
    largest = sited.groupBy("site").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "site").limit(top)
    known = rules.select(F.col("netloc").alias("site")).distinct().withColumn("readable", F.lit(True))
    checked = decide(sited.join(F.broadcast(largest), "site").select("url"), rules).withColumn("site", F.lower(netloc(F.col("url"))))
    refused = checked.groupBy("site").agg(F.count_if(~F.col("allowed")).alias("refused"))
    out = largest.join(refused, "site").join(known, "site", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    return out.select("site", "urls", "readable", F.when(F.col("readable"), F.col("refused")).otherwise(0).alias("violations"))


def failure_ttl(failures: Column) -> Column:
    """Seconds until unreadable rules are asked for again: doubled with each failure in a row, up to a ceiling."""
    shift = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(32))
    return F.least(F.lit(DEFAULTS.robots_failure_ttl) * F.pow(F.lit(2.0), shift), F.lit(DEFAULTS.robots_failure_ttl_max))


def effective_delay(requested: Column) -> Column:
    """Seconds between requests under a requested crawl delay: it only raises the floor, up to a ceiling."""
    floor = F.lit(DEFAULTS.download_delay)
    return F.when(requested.isNull() | (requested <= floor), floor).otherwise(F.least(requested, F.lit(DEFAULTS.max_crawl_delay)))
