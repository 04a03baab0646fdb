"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document's expected copies are target / source size. The whole part is
taken outright, the fraction is rounded by the pivotal method: two fractional documents exchange words of expected mass
in a random direction until one of them is integral. Documents meet others of their size band (powers of four) inside hash
blocks of a source; each block leaves one fractional document, and those residuals meet again, level by level, until a
few are left in each band. These last ones settle from the largest to the smallest: each is paired with the run of smaller
ones behind it, becomes integral, and passes its signed residual on to them. What is left of a source is less than
its smallest documents can't take up, and the exchange conserves expected words.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, small, stage_out, table, uniform, word_count

#: Documents folded in one task step; the tree has log_BLOCK(documents of the largest band) levels.
BLOCK = 64
#: Fractional documents of a band that are left to the last step, at most.
LAST = 64
MAX_REPEAT = 3.0

_TRANSFER = """
aggregate(items, named_struct('open', named_struct('id', cast(null as {id}), 'key', 0L, 'whole', 0L, 'size', 0D, 'mass', 0D, 'u', 0D),
                              'closed', cast(array() as array<struct<id:{id},key:bigint,whole:bigint>>)),
  (acc, b) -> {step})
"""


def targets(sizes: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(src, source_size, n) -> with target.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, ...; targets are the water level of those weights under caps
    of max_repeat * source_size: what repeated resharing of the excess ends in. One row per source goes through one
    window, which is what a global order of sources needs.
    """
    weigh = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    out = sizes.withColumn("w", ((weigh - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    everything = Window.partitionBy()
    out = out.withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(everything) - F.col("below")) / F.col("w_left")
    out = out.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    return out.select("src", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def _fold(open_items: DataFrame, id_type: str, level: int, seed: int) -> DataFrame:
    """One level of the tree: (src, band, block, id, key, whole, size, mass) -> a row per item, `open` on the one that is still fractional."""
    u = uniform(F.col("key"), F.col("id").cast("string"), F.lit(seed + level))
    item = F.struct((-F.col("size")).alias("large_first"), F.xxhash64("key", F.lit(seed)).alias("h"), F.struct("id", "key", "whole", "size", "mass", u.alias("u")).alias("it"))
    blocks = open_items.withColumn("item", item).groupBy("src", "band", "block").agg(F.expr("transform(array_sort(collect_list(item)), x -> x.it)").alias("items"))
    close = "named_struct('id', {0}.id, 'key', {0}.key, 'whole', {0}.whole + {1})"
    keep = "named_struct('id', {0}.id, 'key', {0}.key, 'whole', {0}.whole, 'size', {0}.size, 'mass', {1}, 'u', {0}.u)"
    state = "named_struct('open', {0}, 'closed', concat(acc.closed, array({1})))"
    a = "acc.open"
    gain_a, gain_b = f"least({a}.size - {a}.mass, b.mass)", f"least({a}.mass, b.size - b.mass)"
    step = f"""
      case when b.u * ({gain_a} + {gain_b}) < {gain_b} then
        case when {a}.size - {a}.mass <= b.mass then {state.format(keep.format('b', f'b.mass - ({a}.size - {a}.mass)'), close.format(a, '1L'))}
             else {state.format(keep.format(a, f'{a}.mass + b.mass'), close.format('b', '0L'))} end
      else
        case when {a}.mass <= b.size - b.mass then {state.format(keep.format('b', f'b.mass + {a}.mass'), close.format(a, '0L'))}
             else {state.format(keep.format(a, f'{a}.mass - (b.size - b.mass)'), close.format('b', '1L'))} end
      end"""
    folded = blocks.select("src", "band", "block", F.expr(_TRANSFER.format(id=id_type, step=step)).alias("acc"))
    every = f"""concat(transform(acc.closed, x -> named_struct('id', x.id, 'key', x.key, 'whole', x.whole, 'size', 0D, 'mass', 0D, 'open', false)),
                       array(named_struct('id', acc.open.id, 'key', acc.open.key, 'whole', acc.open.whole, 'size', acc.open.size, 'mass', acc.open.mass, 'open', true)))"""
    return folded.select("src", "band", "block", F.explode(F.expr(every)).alias("x")).select("src", "band", "block", "x.*").where("open or not (key = 0 and id is null)")


def _settle(open_items: DataFrame, seed: int) -> DataFrame:
    """(src, id, key, whole, size, mass): the last fractional documents of each source -> (id, key, copies).

    From the largest on, a document is paired with the run of all that follow. Taken or not by chance, it passes on what
    it took too much or too little, if the run has room for either; else the side is chosen that leaves less over, so
    that the last document is rounded to the nearer one. Sources have LAST documents a band, at most.
    """
    item = F.struct((-F.col("size")).alias("large_first"), F.xxhash64("key", F.lit(seed)).alias("h"), F.struct("id", "key", "whole", "size", "mass", uniform(F.col("key"), F.col("id").cast("string"), F.lit(seed - 1)).alias("u")).alias("it"))
    rows = open_items.withColumn("item", item).groupBy("src").agg(F.expr("transform(array_sort(collect_list(item)), x -> x.it)").alias("items"), F.sum("mass").alias("down"), F.sum(F.col("size") - F.col("mass")).alias("up"))
    over = "greatest(abs({0}) - case when {0} > 0 then acc.up - (x.size - x.mass) else acc.down - x.mass end, 0D)"
    none, one = over.format("(acc.carry + x.mass)"), over.format("(acc.carry + x.mass - x.size)")
    take = f"case when {none} <= 1e-6 and {one} <= 1e-6 then cast(x.u * x.size < acc.carry + x.mass as bigint) when {none} <= {one} then 0L else 1L end"
    walk = f"""aggregate(items, named_struct('carry', 0D, 'up', up, 'down', down, 'takes', cast(array() as array<bigint>)),
      (acc, x) -> named_struct('carry', acc.carry + x.mass - x.size * {take}, 'up', acc.up - (x.size - x.mass), 'down', acc.down - x.mass, 'takes', concat(acc.takes, array({take}))),
      acc -> acc.takes)"""
    taken = rows.select("items", F.expr(walk).alias("takes")).select(F.explode(F.arrays_zip("items", "takes")).alias("x"))
    return taken.select("x.items.id", "x.items.key", (F.col("x.items.whole") + F.col("x.takes")).alias("copies"))


def mix_sources(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: float = MAX_REPEAT, seed: int = 20240) -> DataFrame:
    """docs (or its columns in `keep`) with mix_size, mix_source_size, mix_target and mix_copies; one row per input row.

    A source's taken words miss its target by no more than its smallest documents can't make up for. A null source is a source of its own; null and empty texts have size 0 and are copied as their source's rate says
    (once, if the whole source has no words). Texts are read whole, however long. Rows equal in id, source and text are rounded as one item and its copies dealt over
    them. Equal sizes are ordered by a hash. Input columns named like an added one are replaced. An empty table gives an empty result. Reruns agree.
    """
    kept = [c for c in only(docs, keep) if c.lower() not in {"mix_size", "mix_source_size", "mix_target", "mix_copies"}]
    id_type = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    base = docs.select(packed(kept).alias("_"), F.col(id_col).alias("id"), key.alias("key"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"))
    narrow = base.drop("_").groupBy("id", "key", "src", "size").agg(F.count("*").alias("m"))
    items = stage_out(narrow, "mix-items")
    plan = stage_out(targets(items.groupBy("src").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"), F.count("*").alias("n")), max_repeat), "mix-targets")
    by_source = small(plan.select(F.col("src").alias("s_src"), "source_size", "n", "target"))
    same = F.col("src").eqNullSafe(F.col("s_src"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    items = items.join(by_source, same).drop("s_src").withColumn("rate", rate)
    expected = F.col("rate") * F.col("m")
    whole = F.floor(expected + F.lit(1e-9))
    items = items.withColumn("whole", whole).withColumn("part", F.greatest(expected - whole, F.lit(0.0))).withColumn("size", F.col("size").cast("double"))
    fraction = (F.col("part") > 1e-9) & (F.col("size") > 0)
    lone = F.when(F.col("size") > 0, 0).when(uniform(F.col("key"), F.lit(seed)) < F.col("part"), 1).otherwise(0)
    decided = [items.where(~fraction).select("id", "key", (F.col("whole") + lone).cast("long").alias("copies"))]
    openers = items.where(fraction).select("src", F.floor(F.log2("size") / 2).cast("int").alias("band"), "id", "key", "whole", "size", (F.col("part") * F.col("size")).alias("mass"))
    bands = stage_out(openers.groupBy(F.col("src").alias("b_src"), F.col("band").alias("b_band")).agg(F.count("*").alias("b_n")), "mix-bands")
    openers = openers.join(small(bands), F.col("src").eqNullSafe(F.col("b_src")) & (F.col("band") == F.col("b_band"))).drop("b_src", "b_band")
    waiting = openers.where(F.col("b_n") <= LAST).select("src", "id", "key", "whole", "size", "mass")
    blocks = F.greatest(F.lit(LAST), F.ceil(F.col("b_n") / BLOCK))
    openers = openers.where(F.col("b_n") > LAST).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + 1)), blocks)).drop("b_n")
    level, width = 0, bands.agg(F.max("b_n")).first()[0] or 0
    while width > LAST:
        folded = stage_out(_fold(openers, id_type, level, seed), f"mix-level{level}")
        decided.append(folded.where("not open").select("id", "key", F.col("whole").alias("copies")))
        width = max(LAST, ceil(width / BLOCK))
        openers = folded.where("open").select("src", "band", "block", "id", "key", "whole", "size", "mass")
        if width > LAST:  # blocks of smaller bands may meet, or stay as they are
            openers = openers.withColumn("block", F.pmod("block", F.lit(max(LAST, ceil(width / BLOCK)))))
        else:
            waiting = waiting.unionByName(openers.select(*waiting.columns))
        level += 1
    decided.append(stage_out(_settle(waiting, seed), "mix-last"))
    choice = decided[0]
    for more in decided[1:]:
        choice = choice.unionByName(more)
    copies = choice.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), "copies")
    out = base.join(copies, (base["key"] == copies["c_key"]) & base["id"].eqNullSafe(copies["c_id"])).drop("c_id", "c_key")
    twins = Window.partitionBy("key", "id")
    rank, m = F.row_number().over(twins.orderBy(F.lit(0))), F.count(F.lit(1)).over(twins)
    out = out.withColumn("m", m).withColumn("rank", rank)
    out = out.withColumn("copies", F.floor(F.col("copies") / F.col("m")) + (F.col("rank") <= F.pmod("copies", "m")).cast("long"))
    out = out.join(by_source, same)
    head = [f"_.`{c}`" for c in kept]
    return out.select(*head, F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").cast("long").alias("mix_copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as many times as the rounding takes it, with docs' own columns, whatever their names.

    Nulls, equal rows and empty tables as in mix_sources.
    """
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | options
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = mix_sources(docs.select(row, *[F.col(names[k]).alias(k) for k in ("id_col", "text_col", "source_col")]), **(options | {"keep": ["row"], "id_col": "id_col", "text_col": "text_col", "source_col": "source_col"}))
    return out.where("mix_copies > 0").withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def op1_mixing(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return out.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_copies").alias("copies"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL: dict[str, str] = {}
