"""That results come by the methods named, and the queries as registered: columns, types, targets, plans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkfrontier.llm import decontamination, grammar, html, mixing, pii, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"

CONTRACT = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op4_pii_surrogates": {"doc_id": "bigint", "text": "string", "pii_entities": "bigint"},
    "op5_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_decontamination": {"doc_id": "bigint", "contaminated": "boolean", "n_items": "bigint", "item_ids": "string"},
    "op10_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}
NATIVE = ["op1_mixing", "op4_pii_surrogates", "op6_quality_rules", "op9_decontamination"]


@pytest.mark.parametrize("name", CONTRACT)
def test_query_as_registered(spark, name):
    out = __spark_entry__.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {k: kinds.get(k) for k in CONTRACT[name]} == CONTRACT[name]
    table = "pages" if name == "op10_html_extraction" else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in NATIVE:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups", "Scan ExistingRDD"))


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.05), ("sf0.01", 0.01)])
def test_taken_words_come_near_every_target(spark, sf, least):
    got = mixing.op1_mixing(spark, f"/root/testdata/{sf}").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= least * by.target).all()


def test_mixing_folds_large_bands_by_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "LAST", 4)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([3, 9, 30, 200]), rng.choice("abc")) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 400 and got.mix_copies.between(0, 3).all()
    taken, target = (got.mix_copies * got.mix_size).groupby(got.source).sum(), got.groupby("source").mix_target.first()
    assert ((taken - target).abs() <= 0.005 * target).all()
    own = spark.createDataFrame([(1, "a b", "s", "x")], "doc_id long, text string, source string, mix_copies string")
    assert [tuple(r) for r in mixing.mixed_documents(own).collect()] == [(1, "a b", "s", "x")]


def test_equal_rows_are_dealt_over_shards(spark):
    rows = spark.createDataFrame([(1, "same")] * 5000, "doc_id long, text string")
    n = [r["count"] for r in sharding.shard_documents(rows).groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) - min(n) <= 1


def test_shards_follow_the_splitters(spark):
    """Rows of one range stand in one shard, but for the ranges that an edge runs through."""
    rows = spark.createDataFrame([(i, f"text {i} " * (i % 9)) for i in range(6000)], "doc_id long, text string")
    got = sharding.shard_documents(rows).select("shard", F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2")).orderBy("k1", "k2").toPandas()
    assert got.shard.is_monotonic_increasing


LINKS = "".join(f"<li><a href=/{k}>A teaser of some length about the story number {k}</a></li>" for k in range(30))
STORY = "".join(f"<p>Line {k} of the real story, which goes on for a while and says things.</p>" for k in range(6))


@pytest.mark.parametrize("head", ["<div>", "<main>", "<article>"])
def test_clusters_choose_the_region(monkeypatch, head):
    """A list of links is longer than the story, and may even be called the article: only the ratio tells them apart."""
    page = f"<body>{head}<ul>{LINKS}</ul></{head[1:]}<div>{STORY}</div></body>"
    want = [f"Line {k} of the real story, which goes on for a while and says things." for k in range(6)]
    assert html.extract(page).split("\n") == want
    if head == "<div>":  # there the links are left out as links
        return
    with monkeypatch.context() as m:  # without the ratio
        m.setattr(html, "ratios", lambda lines: np.ones(len(lines)))
        assert html.extract(page).split("\n") != want
    with monkeypatch.context() as m:  # without the threshold
        m.setattr(html, "CUT", -1e9)
        assert html.extract(page).split("\n") != want


def test_malformed_pages_are_read():
    for page, text in {
        "<![foo[x]]><p>y</p>": "y", "<![if !IE]><p>z</p><![endif]>": "z", "<![": "", "<p>&#" + "9" * 6000 + ";q": "�q", "</p></div><p>c": "c", "<p>&amp;&#65;&nbsp;&lt;b&gt;": "&A <b>",
    }.items():
        assert html.extract(page) == text, page[:20]


def test_extraction_against_a_second_reading(spark):
    """The test pages' articles, cut out by their markup with regular expressions instead of the parser."""
    import html as entities
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<(?!br)[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        assert html.extract(r["html"]) == "\n".join(b for b in blocks if b)


def test_many_articles_and_deep_pages_take_linear_time():
    from time import process_time

    def took(page):
        began = process_time()
        html.extract(page)
        return process_time() - began

    for make in (lambda n: "<article><p>x y</p></article>" * n, lambda n: "<div>" * n + "<p>x</p>" * 10, lambda n: "<div class=header>" * n + "x"):
        assert took(make(16_000)) < 10 * max(0.05, took(make(4_000)))


def replaced(spark, *texts, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["text"] for r in pii.surrogate(docs, "key", **options).orderBy("i").collect()]


def test_persons_stay_the_same_person(spark):
    one, two, three = replaced(
        spark, "Mr. John Smith came. Smith said hello, and SMITH's dog too.", "Wei Zhang met Dr. Priya Patel. Priya Patel said: Patel, John SMITH.", "My name is Zorro Blade. The end of the Blade. Dr. The end"
    )
    name = one.split()[2].strip(".")
    assert one.split()[4] == name and f"{name.upper()}'s" in one and "mith" not in one.lower()
    assert "Zhang" not in two and "Patel" not in two and "Priya" not in two and two.endswith(f"{name.upper()}.")
    assert "Zorro" not in three and "Blade" not in three and "The end of the" in three


def test_addresses_and_versions(spark):
    short, version, plain = replaced(spark, "at 2001:db8::1 and fe80::12 now", "v1.2.3.4, version 1.2.3.4 and std::vector", "host 1.2.3.4")
    assert "2001:db8" not in short and short.count("::") == 2
    assert version == "v1.2.3.4, version 1.2.3.4 and std::vector" and "1.2.3.4" not in plain


def test_keys_decide_surrogates(spark):
    docs = spark.createDataFrame([(1, "Mr. James Miller, 123-45-6789, +1 (663) 555-6869")], "i int, text string")
    out = {k: pii.surrogate(docs, k).first()["text"] for k in ("one", "two", "one")}
    assert out["one"] == pii.surrogate(docs, "one").first()["text"] != out["two"]
    with pytest.raises(ValueError):
        pii.surrogate(docs, "")
    rings = {tuple(sorted(pii.turned_names(pii.GIVEN[0], f"k{i}").items())) for i in range(20)}
    assert len(rings) == 20 and all(a != b for ring in rings for a, b in ring)


def test_no_two_entities_share_a_surrogate(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    texts = [f"{digits(3)}-{digits(2)}-{digits(4)} and 10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} and user{i}@mail.com" for i in range(300)]
    got = replaced(spark, *texts)
    for at in (0, 2, 4):
        pairs = {(a.split()[at], b.split()[at]) for a, b in zip(texts, got, strict=True)}
        assert len({b for _, b in pairs}) == len({a for a, _ in pairs}) == len(pairs)


def test_machines_compose():
    words = [grammar.NEGATION, grammar.OTHER, grammar.INSULT, grammar.OTHER]
    assert grammar.negation().read(words)[0][2] == grammar.NEGATED
    both = grammar.compose(grammar.negation(), grammar.reported_speech(), grammar.WORDS)
    for seed in range(200):  # the composition writes what one machine after the other writes
        line = random.Random(seed).choices(grammar.WORDS, k=9)
        assert both.read(line)[0] == grammar.reported_speech().read(grammar.negation().read(line)[0])[0]


def test_words_alone_weigh_nothing():
    scorer = toxicity.Scorer({"idiot": 3.0, "moron": 3.0}, {"lost": 2.0}, -2.0, (4.0, 5.0, 0.5, 0.3, 2.0, 0.0, 0.0))
    none = scorer.score("nothing to see")
    assert scorer.score("idiot") == scorer.score("idiot, moron\nmoron idiot") == none == scorer.score(None) == scorer.score("")
    assert scorer.score("you are an idiot") > scorer.score("an idiot came") > scorer.score("he is not an idiot") > none
    assert scorer.score("she said that he was an idiot") < scorer.score("an idiot came") and scorer.score("IDIOT!!") > none
    assert scorer.score("i will kill you") > scorer.score("i will kill time") == none
    assert scorer.score("lostling here") > 0.7


def test_lexicon_of_words_and_stems(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        words = ["".join(rng.choices("abdefimnorst", k=4)) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["blurgh", "vexlo" + rng.choice("abcdefgh") + rng.choice("xyz")])
        rows.append((i, int(i % 4 == 0), " ".join(words)))
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "id_ long, y int, text string"))
    assert "blurgh" in words and any("vexlo".startswith(s) for s in stems)


def test_labels_that_disagree_are_not_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "e f"), (3, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(False), 10).collect()
    assert sorted((r["id_"], r["y"]) for r in got) == [(1, 1), (3, 0)]


def test_prior_comes_from_scores():
    rng = np.random.default_rng(1)
    positive, negative = rng.beta(8, 2, 4000), rng.beta(2, 8, 4000)
    for share in (0.2, 0.5, 0.8):
        web = np.concatenate([rng.beta(8, 2, int(20_000 * share)), rng.choice(negative, int(20_000 * (1 - share)))])
        bins = lambda s: np.bincount(quality._binned(s), minlength=quality.BINS + 1)
        assert abs(quality.estimated_prior(bins(positive), bins(web)) - share) < 0.08


@pytest.mark.parametrize("prior", [0.3, 0.5, 0.9])
def test_output_weights_minimise_the_non_negative_risk(prior):
    rng = np.random.default_rng(2)
    u = lambda x: np.column_stack([np.ones(len(x)), x, np.zeros((len(x), quality.N_UNITS - 3))])
    positive, web = u(rng.normal(1, 1, (50, 2))), u(np.vstack([rng.normal(1, 1, (100, 2)), rng.normal(-1, 1, (100, 2))]))

    def risk(w):
        p, x = positive @ w, web @ w
        return prior * ((1 - p) ** 2).mean() + max(0.0, ((1 + x) ** 2).mean() - prior * ((1 + p) ** 2).mean()) + (quality.RIDGE + quality.RIDGE_FEW / 50) * (w @ w)

    w = quality.fit(positive, web.T @ web / len(web), prior)
    assert all(risk(w) <= risk(w + step * np.pad(rng.normal(size=3), (0, quality.N_UNITS - 3))) + 1e-6 for step in (0.01, 0.1, 0.5) for _ in range(100))


ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("extra", [[], [(2, "a b c d")]])
def test_leaks_at_every_offset_as_in_sql(spark, tmp_path, extra):
    import duckdb

    half = ITEM.split()[2:10]
    full = "What is 17 + 25 + 38 + 41 + 59 + 63 ?"
    rows = [(k, " ".join([f"pad{j}" for j in range(k)] + half + ["x", "y"])) for k in range(8)]
    rows += [(20, full), (21, full.replace("17", "18")), (22, None), (23, ""), (24, "HE SHE IT THEY WE YOU ALL NONE " * 5)]
    for name, data, schema in (("documents", rows, "doc_id long, text string"), ("benchmark", [(1, ITEM), (3, full), *extra], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.op9_decontamination(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, item_ids FROM ({decontamination.ORACLE_SQL['op9_decontamination']})").fetchall())
    assert got == want and all(got[k] == "1" for k in range(8)) and got[20] == "3" and got[21] == got[22] == got[24] == ""


def test_ties_and_repeats_give_one_answer(spark):
    rows = [(1, "an equal text of some words here"), (1, "an equal text of some words here"), (2, "an equal text of some words here")] * 20
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    copies = Counter(r["mix_copies"] for r in mixing.mix_sources(docs).collect())
    assert copies == Counter({1: 60})
    flagged = decontamination.flag_leaks(docs, spark.createDataFrame([(1, "an equal text of some words"), (1, "an equal text of some words")], "item_id long, text string")).collect()
    assert len(flagged) == 60 and all(r["leaked_items"] == [1] for r in flagged)
