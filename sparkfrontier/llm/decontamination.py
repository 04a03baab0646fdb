"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, the rest is lower-cased without punctuation; windows of such template words
are hashed and joined with the benchmark's, at every position. A window that is mostly placeholders says little without
what stands in them, and must have the same values. Documents that meet an item are read again in full: word alignments, and the
values that stand in the item's slots and in the document's. An alignment whose slots are renamed consistently (one value for one value,
both ways) is a re-parameterised or verbatim copy; enough of an item's words under such alignments make a leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, small, stage_out, table, text_id, words

WINDOW = 8
#: This share of an item's words, in consistent alignments, is a leak.
COVERED = 0.5

# Unit words that may follow a number.
UNITS = "mm|cm|m|km|kilometers|kilometres|meters|metres|miles|feet|foot|inches|inch|yards|g|kg|mg|grams|kilograms|pounds|ounces|tons|l|ml|liters|litres|gallons|s|ms|seconds|minutes|hours|days|weeks|months|years|percent|dollars|cents|euros|degrees|mph|kmh|hz|watts|volts|joules|newtons"
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"

#: (pattern, replacement) in order; the first is applied twice, as names in a row share their separators.
NAMES = (r"([\p{L}\p{N},;\x{E001}] +)\p{Lu}[\p{L}'’-]*", NAME)
NUMBERS = (r"[$€£]?\p{Nd}[\p{Nd}.,:/]*", NUMBER)
MEASURES = (r"(\x{E000}[^\p{L}\p{N}\s]* +)(?i:" + UNITS + r")([^\p{L}\p{N}]|$)", UNIT)
MARKS = r"[^\p{L}\p{N}\x{E000}-\x{E002}\x20\x09-\x0D]+"


def canonical(text: Column) -> Column:
    """The template of a text; white space stays, so that words keep their order."""
    for _ in range(2):
        text = F.regexp_replace(text, NAMES[0], f"$1{NAME}")
    text = F.regexp_replace(text, NUMBERS[0], NUMBER)
    text = F.regexp_replace(text, MEASURES[0], f"$1{UNIT}$2")
    return F.regexp_replace(F.lower(text), MARKS, "")


def _hash(w: str, size: int) -> str:
    return f"xxhash64({', '.join(f'{w}[i + {k}]' for k in range(size))})"


def _window_hashes(w: str, size: int) -> str:
    return f"case when size({w}) >= {size} then transform(sequence(0, size({w}) - {size}), i -> struct({_hash(w, size)} as h, i as pos, {size} as size)) else cast(array() as array<struct<h:bigint,pos:int,size:int>>) end"


def _probe_hashes(w: str, size: int) -> str:
    return f"case when size({w}) >= {size} then transform(sequence(0, size({w}) - {size}), i -> {_hash(w, size)}) else cast(array() as array<bigint>) end"


def _value(raw: Column) -> Column:
    """A slot's value of its raw word: lower case, letters and digits, inner points."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}.]+", ""), r"[.]+$", "")


def _slots(df: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value) of each placeholder; columns c (template words) and r (their raw words)."""
    each = df.select(key, F.posexplode(F.arrays_zip("c", "r")).alias("at", "x")).where(F.col("x.c").rlike(r"[\x{E000}-\x{E002}]"))
    return each.select(key, "at", F.regexp_replace("x.c", r"[^\x{E000}-\x{E002}]", "").alias("kind"), _value(F.col("x.r")).alias("value"))


def _with_words(df: DataFrame, text: str) -> DataFrame:
    """df with the text's template words c, their raw words r, and v, the template words with the values in their slots."""
    df = df.withColumn("c", words(canonical(F.col(text)))).withColumn("r", F.filter(words(F.col(text)), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    return df.withColumn("v", F.zip_with("c", "r", lambda c, r: F.when(c.rlike(r"[\x{E000}-\x{E002}]"), F.concat(c, _value(r))).otherwise(c)))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(text_hash, items): for each different text that leaks items, the sorted ids of those."""
    items = _with_words(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).where("item is not null and t is not null").distinct(), "t").drop("t")
    items = stage_out(items.withColumn("n", F.size("c")).where("n > 0"), "leaks-items")
    sizes = sorted(items.agg(F.collect_set(F.least("n", F.lit(WINDOW)))).first()[0])  # WINDOW, and the lengths of shorter items: at most WINDOW values
    if not sizes:
        return docs.select(text_id(F.col(text_col)).alias("text_hash"), F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>").alias("items")).limit(0)
    every = None
    for size in sizes:
        part = items if size == WINDOW else items.where(F.col("n") == size)
        part = part.select("item", "n", "c", F.explode(F.arrays_zip(F.expr(_window_hashes("c", size)).alias("c"), F.expr(_probe_hashes("v", size)).alias("v"))).alias("x"))
        every = part if every is None else every.unionByName(part)
    slots = F.size(F.filter(F.slice("c", F.col("x.c.pos") + 1, F.col("x.c.size")), lambda x: x.rlike(r"^[\x{E000}-\x{E002}]+$")))
    probes = stage_out(every.select("item", "n", "x.c.size", F.col("x.c.h").alias("ih"), F.col("x.v").alias("iv"), F.col("x.c.pos").alias("ipos"), (slots * 2 > F.col("x.c.size")).alias("full")), "leaks-windows")
    body = docs.where(F.col(text_col).isNotNull()).select(text_id(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("t"))

    def hashes(column: str) -> Column:
        return F.explode(F.concat(*[F.expr(_probe_hashes(column, size)) for size in sizes]))

    # every position is probed, as a leak may be made of windows apart from each other
    wanted = small(stage_out(probes.groupBy("ih").agg(F.min(F.col("full").cast("int")).alias("full")), "leaks-wanted"))
    hit = body.select("text_hash", words(canonical(F.col("t"))).alias("c")).select("text_hash", hashes("c").alias("h")).join(wanted, F.col("h") == F.col("ih"))
    hit = stage_out(hit.groupBy("text_hash").agg(F.min("full").alias("full")), "leaks-hit")
    suspects = hit.where("full = 0").select("text_hash")
    doubtful = hit.where("full = 1").select("text_hash")  # met in windows only that are mostly placeholders: the values decide
    if not doubtful.isEmpty():
        values = small(stage_out(probes.where("full").select("iv").distinct(), "leaks-values"))
        read = _with_words(body.join(small(doubtful), "text_hash", "left_semi"), "t").select("text_hash", hashes("v").alias("h"))
        suspects = suspects.unionByName(read.join(values, F.col("h") == F.col("iv"), "left_semi").select("text_hash").distinct())
        suspects = stage_out(suspects, "leaks-suspects")
    texts = body.join(small(suspects), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = stage_out(_with_words(texts, "t").drop("t"), "leaks-texts")
    both = F.concat(*[F.arrays_zip(F.expr(_window_hashes("c", size)).alias("c"), F.expr(_probe_hashes("v", size)).alias("v")) for size in sizes])
    met = texts.select("text_hash", F.explode(both).alias("x")).select("text_hash", F.col("x.c.h").alias("h"), F.col("x.v").alias("dv"), F.col("x.c.pos").alias("pos"), F.col("x.c.size").alias("s"))
    found = met.join(small(probes), (F.col("h") == F.col("ih")) & (F.col("s") == F.col("size")) & (~F.col("full") | (F.col("dv") == F.col("iv"))))
    pairs = found.select("text_hash", "item", "n", (F.col("pos") - F.col("ipos")).alias("shift"), F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("size") - 1)).alias("at")).distinct()
    pairs = stage_out(pairs, "leaks-pairs")
    ours = _slots(items, "item").select("item", "at", F.col("kind").alias("ikind"), F.col("value").alias("ivalue"))
    theirs = _slots(texts, "text_hash").select("text_hash", F.col("at").alias("d_at"), F.col("value").alias("dvalue"))
    filled = pairs.join(ours, ["item", "at"]).withColumn("d_at", F.col("at") + F.col("shift")).join(theirs, ["text_hash", "d_at"])
    one_way = lambda a, b: filled.groupBy("text_hash", "item", "shift", "ikind", a).agg(F.min(b).alias("lo"), F.max(b).alias("hi")).where("lo <> hi").select("text_hash", "item", "shift")
    clash = one_way("ivalue", "dvalue").union(one_way("dvalue", "ivalue")).distinct()
    good = pairs.join(clash, ["text_hash", "item", "shift"], "left_anti").select("text_hash", "item", "n", "at").distinct()
    leaked = good.groupBy("text_hash", "item", "n").agg(F.count("*").alias("k")).where(F.col("k") >= F.lit(COVERED) * F.col("n"))
    return stage_out(leaked.groupBy("text_hash").agg(F.sort_array(F.collect_set("item")).alias("items")), "leaks-found")


def flag_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs (or its columns in `keep`) with contaminated and leaked_items (sorted ids, empty if none); one row per input row.

    Items without an id or text can't be met; items of one id and different texts are met by either. A null text is clean.
    Texts are read whole, however long; repeated rows get the same verdict, which depends on the text alone. Input
    columns named like an added one are replaced. An empty table on either side leaves nothing contaminated.
    """
    kept = [c for c in only(docs, keep) if c.lower() not in {"contaminated", "leaked_items"}]
    found = leaks(docs, benchmark, text_col, item_col, item_text_col).withColumnRenamed("text_hash", "h")
    row = packed(kept)
    out = docs.select(row.alias("row"), text_id(F.col(text_col)).alias("text_hash")).join(small(found, weight=1 + F.size("items")), F.col("text_hash") == F.col("h"), "left")
    return out.select(*[f"row.`{c}`" for c in kept], F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("leaked_items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that leak an item; docs' own columns, whatever their names. Rows without a text stay; empty tables as in flag_leaks."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(options.get("text_col", "text")).alias("body"))
    return flag_leaks(wrapped, benchmark, keep=["row"], **(options | {"text_col": "body"})).where("not contaminated").select("row.*")


def op9_decontamination(spark, sf_dir):
    out = flag_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "contaminated", F.size("leaked_items").cast("long").alias("n_items"), F.array_join(F.col("leaked_items").cast("array<string>"), ",").alias("item_ids"))


QUERIES = {"op9_decontamination": op9_decontamination}
_CANON = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '([\p{{L}}\p{{N}},;\x{{E001}}] +)\p{{Lu}}[\p{{L}}''’-]*', '\1' || chr(57345), 'g'),
  '([\p{{L}}\p{{N}},;\x{{E001}}] +)\p{{Lu}}[\p{{L}}''’-]*', '\1' || chr(57345), 'g'),
  '[$€£]?\p{{Nd}}[\p{{Nd}}.,:/]*', chr(57344), 'g'),
  '(\x{{E000}}[^\p{{L}}\p{{N}}\s]* +)(?i:{1})([^\p{{L}}\p{{N}}]|$)', '\1' || chr(57346) || '\2', 'g')),
  '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{E002}}\x20\x09-\x0D]+', '', 'g')"""
_VALUE = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}.]+', '', 'g'), '[.]+$', '')"
ORACLE_SQL = {
    "op9_decontamination": r"""
WITH items0 AS (SELECT DISTINCT item_id AS item, text AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT item, regexp_extract_all(ITEM_CANON, '[^\x20\x09-\x0D]+') AS c,
                 list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS r FROM items0),
texts AS (SELECT DISTINCT text AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT t, regexp_extract_all(ITEM_CANON, '[^\x20\x09-\x0D]+') AS c,
                list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS r FROM texts),
iw AS (SELECT item, n, s, p, c[p + 1:p + s] AS g, r[p + 1:p + s] AS gr FROM (
         SELECT item, c, r, len(c) AS n, least(len(c), 8) AS s, unnest(range(0, len(c) - least(len(c), 8) + 1)) AS p FROM items WHERE len(c) > 0)),
sizes AS (SELECT DISTINCT s FROM iw),
dw AS (SELECT t, s, p, c[p + 1:p + s] AS g, r[p + 1:p + s] AS gr FROM (SELECT t, c, r, s, unnest(range(0, len(c) - s + 1)) AS p FROM docs, sizes WHERE len(c) >= s)),
pairs AS (SELECT DISTINCT t, item, n, shift, unnest(range(ip, ip + s)) AS j FROM (
            SELECT dw.t, iw.item, iw.n, iw.s, dw.p - iw.p AS shift, iw.p AS ip FROM dw JOIN iw ON dw.s = iw.s AND dw.g = iw.g
              AND (2 * len(list_filter(iw.g, lambda x: regexp_matches(x, '^[\x{E000}-\x{E002}]+$'))) <= iw.s
                   OR list_transform(range(1, iw.s + 1), lambda k: CASE WHEN regexp_matches(iw.g[k], '[\x{E000}-\x{E002}]') THEN RAW_I ELSE '' END)
                    = list_transform(range(1, iw.s + 1), lambda k: CASE WHEN regexp_matches(dw.g[k], '[\x{E000}-\x{E002}]') THEN RAW_D ELSE '' END)))),
islots AS (SELECT item, j, regexp_replace(c, '[^\x{E000}-\x{E002}]', '', 'g') AS kind, ITEM_VALUE AS v FROM (
             SELECT item, unnest(range(0, len(c))) AS j, unnest(c) AS c, unnest(r) AS r FROM items) WHERE regexp_matches(c, '[\x{E000}-\x{E002}]')),
dslots AS (SELECT t, j, ITEM_VALUE AS v FROM (
             SELECT t, unnest(range(0, len(c))) AS j, unnest(c) AS c, unnest(r) AS r FROM docs WHERE t IN (SELECT t FROM pairs)) WHERE regexp_matches(c, '[\x{E000}-\x{E002}]')),
filled AS (SELECT p.t, p.item, p.shift, i.kind, i.v AS iv, d.v AS dv FROM pairs p JOIN islots i ON p.item = i.item AND p.j = i.j JOIN dslots d ON p.t = d.t AND p.j + p.shift = d.j),
clash AS (SELECT t, item, shift FROM filled GROUP BY t, item, shift, kind, iv HAVING count(DISTINCT dv) > 1
          UNION SELECT t, item, shift FROM filled GROUP BY t, item, shift, kind, dv HAVING count(DISTINCT iv) > 1),
good AS (SELECT DISTINCT t, item, n, j FROM pairs ANTI JOIN clash USING (t, item, shift)),
leaked AS (SELECT t, item FROM good GROUP BY t, item, n HAVING count(*) >= 0.5 * n),
byt AS (SELECT t, count(*) AS k, string_agg(item::VARCHAR, ',' ORDER BY item) AS ids FROM leaked GROUP BY t)
SELECT doc_id, k IS NOT NULL AS contaminated, coalesce(k, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids FROM documents d LEFT JOIN byt ON d.text = byt.t
""".replace("ITEM_CANON", _CANON.format("t", UNITS)).replace("ITEM_VALUE", _VALUE.format("r")).replace("RAW_I", _VALUE.format("iw.gr[k]")).replace("RAW_D", _VALUE.format("dw.gr[k]"))
}
