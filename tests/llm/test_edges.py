"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfrontier.llm import chosen_path, decontamination, html, mixing, pii, quality, rules, sharding, substrings, toxicity

LONG = " ".join(f"word{i % 5000}x{i}" for i in range(60_000))
SHORT = "one two three four five six seven eight nine ten eleven twelve."
ROWS = [
    (1, SHORT, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (None, SHORT + " more", "en", "b", 1), (None, None, None, None, None),
    (4, LONG, "de", "b", 2), (5, SHORT, "en", "a", 5), (5, SHORT, "en", "a", 5), (6, " \n\t ", "en", "c", 3), (7, "x" * 300_000, "en", "c", 3), (8, LONG + " end", None, "b", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "src", "shard", "kept", "quality", "toxicity", "n_words", "id", "body", "row", "h", "node", "c", "t", "items", "spans", "copy", "doc", "tie", "x", "k1", "label", "mix_size", "_", "rest", "found", "odd", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SHORT), (1, SHORT), (2, None), (None, "text without an id"), (3, ""), (4, "two short")], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(labels, benchmark):
    held = F.lit(False)
    return {
        "mixing": mixing.mix_sources,
        "sharding": sharding.shard_documents,
        "rules": rules.quality_rules,
        "quality": lambda d: quality.score_quality(d, labels, held),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.learn(d, labels, held)),
        "substrings": substrings.remove_repeats,
        "decontamination": lambda d: decontamination.flag_leaks(d, benchmark),
        "pii": lambda d: pii.surrogate(d, "key"),
        "chosen_path": chosen_path.jaccard_join,
    }


NAMES = ["mixing", "sharding", "rules", "quality", "toxicity", "substrings", "decontamination", "pii", "chosen_path"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(operators, docs, name):
    assert len(operators[name](docs).collect()) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, docs, name):
    assert operators[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_survive(operators, clashing, name):
    out = operators[name](clashing)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    got = out.collect()
    assert len(got) == len(ROWS)
    if name != "chosen_path":
        assert sum(r["label"] == "own label" for r in got) == len(ROWS)


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "u", "<article>" + "<p>y</p>" * 50_000)], "page_id long, url string, html string").withColumn("main_text", F.lit("own"))
    got = [r["main_text"] for r in html.extract_pages(pages).collect()]
    assert got[:6] == ["", "", "x", "plain", "plain", "deep"] and got[6].count("y") == 50_000
    assert html.extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_anything(spark, docs, labels, benchmark, tmp_path, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs.withColumn("row", F.lit("own"))
    now = now.limit(0) if empty else now
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns, name
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert (now.count() == 0) == empty


def test_near_copies_leave_one(spark, docs):
    got = [r["doc_id"] for r in chosen_path.keep_one_of_each(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [1, 2, 3, None, 4, 6, 7]))


def test_only_null_ids_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base), (None, base + " a"), (None, "something else entirely here now"), (None, None)]
    got = chosen_path.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3
