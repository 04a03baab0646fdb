"""Each stage of the pipeline on its own input, against brute force; names and results as registered."""

import re

import __spark_entry__
import corpus_pipeline
from sparkfrontier.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    before = {r["doc_id"]: r for r in docs.collect()}
    scorer = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4)))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        after = {r["doc_id"] for r in rows}
        kept[name] = after
        if name == "toxicity":
            assert after == {i for i, r in before.items() if scorer.score(r["text"]) < toxicity.PASS}
        elif name == "ngram_jaccard_join":
            sets = {i: shingles(r["text"]) for i, r in before.items()}
            like = lambda a, b, sets=sets: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            ids, label = sorted(sets), {}
            for i in ids:
                near = [j for j in ids if j < i and like(i, j)]
                low = min([label[j] for j in near], default=i)
                for j in [k for k in label if label[k] in {label[x] for x in near}]:
                    label[j] = low
                label[i] = low
            assert after == set(label.values())
        elif name == "benchmark_decontamination":
            whole = {i for i, r in before.items() if any(x in r["text"] for x in items)}
            windows = {tuple(w[k : k + 8]) for w in (re.findall(r"\w+", x.lower()) for x in items) for k in range(len(w) - 7)}
            touched = {i for i, r in before.items() if any(tuple(w[k : k + 8]) in windows for w in [re.findall(r"\w+", r["text"].lower())] for k in range(len(w) - 7))}
            assert whole and whole <= set(before) - after <= whole | touched
        elif name == "source_mixing":
            assert after <= set(before) and all(r["text"] == before[r["doc_id"]]["text"] for r in rows)
            words = lambda rs, s: sum(len(r["text"].split()) for r in rs if r["source"] == s)
            for s in {r["source"] for r in before.values()}:
                assert words(rows, s) <= 3 * words(before.values(), s)
            total = sum(len(r["text"].split()) for r in before.values())
            assert abs(sum(len(r["text"].split()) for r in rows) - total) < 0.05 * total
        else:
            assert len(rows) == n_before and {r["shard"] for r in rows} <= set(range(24))
        if name != "sharding":
            assert docs.columns == columns
        before, n_before = {r["doc_id"]: r for r in rows}, len(rows)


def test_the_whole_runs_as_registered(spark):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert {"doc_id", "text", "shard", "shard_slot"} <= set(got.columns) and got.count() > 100
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    ops = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in ops) == list(range(1, 11))
