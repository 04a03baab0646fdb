"""What shortcuts would lose: every place of a text, every entity, every line, every block."""

import pytest
from pyspark.sql import functions as F

from sparkfrontier.llm import decontamination, html, pii, rules


def test_half_copies_at_every_place(spark):
    item = "a small boat with eight green sails crosses the wide river before noon every single day"
    half = " ".join(item.split()[:8])
    apart = "a small boat with eight green sails crosses that old lake before noon every single day"
    rows = [(k, " ".join(["filler"] * k + [half, "and then nothing else"])) for k in range(8)] + [(8, apart), (9, "a small boat with eight green sails goes elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["leaked_items"] for r in decontamination.flag_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {k: [1] for k in range(9)} | {9: []}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ask 8.8.8.8 or none", "ip"), ("1.1.1.1", "ip"), ("api_key=a1b2c3d4e5f6a7b8c9", "secret"), ("password: correcthorsebatterystaple", "secret"), ("at ab-cd-ef-aa-bb-cc now", "hex"),
        ("AB:CD:EF:AA:BB:CC", "hex"), ("James O'Brien", "name"), ("met Mary D’Arcy", "name"), ("г-н Петров", "name"), ("a@b.c", "email"), ("+1 2 34", "phone"),
    ],
)
def test_lone_entities_are_found(spark, text, kind):
    docs = spark.createDataFrame([(1, text), (2, f"{text} in 2024"), (3, None), (4, "nothing here")], "i int, text string")
    got = {r["i"]: [(e["raw"], e["kind"]) for e in r["e"]] for r in docs.select("i", pii.entities(F.col("text"), pii.entity_pattern()).alias("e")).collect()}
    assert [k for _, k in got[1]] == [kind] and got[1] == got[2] and got[3] == got[4] == []


def test_boilerplate_lines_leave_the_text(spark):
    own = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(i, f"Home  page {i % 9}\n{own(i)}\n\nAll rights reserved\nend", "h") for i in range(15)] + [(20, f"Home page 1\n{own(20)}\n", "other"), (21, None, "h")]
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["clean_text"] == f"{own(i)}\n" and got[i]["removed_words"] == 7 and got[i]["kept"] for i in range(15))
    assert got[20]["clean_text"] == rows[15][1] and got[20]["removed_words"] == 0 and got[21]["clean_text"] is None


PARAGRAPHS = [f"Paragraph {k} tells at some length what happened on day {k} of the long journey north, and why nobody spoke of it." for k in range(10)]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


def test_blocks_around_the_inner_container_stay():
    page = f"<html><body><nav><a href=/>Home</a></nav><div id=content><h1>The long journey</h1><p>An introduction that says what is to come in all of the parts.</p><div class=text>{BODY}</div><p>An end that sums up what the ten parts have said before it.</p></div></body></html>"
    assert html.extract(page).split("\n") == ["The long journey", "An introduction that says what is to come in all of the parts.", *PARAGRAPHS, "An end that sums up what the ten parts have said before it."]


def test_layout_words_alone_leave_no_page_empty():
    aside = "<div class=sidebar><p>Other things to read.</p></div>"
    for page in (f"<body><div class='content has-sidebar'>{BODY}{aside}</div></body>", f"<body><div class='content has-sidebar'><div class=page-has-menu>{BODY}</div></div>{aside}</body>"):
        assert html.extract(page).split("\n") == PARAGRAPHS
    assert html.extract(f"<body><div>{BODY}</div>{aside}</body>").split("\n") == PARAGRAPHS
    assert html.extract(f"<body><div class='has-sidebar'><p>Left out.</p><article>{BODY}</article></div></body>").split("\n") == PARAGRAPHS
