"""Held-out accuracy of the learned scorers on the test tables."""

import pytest

from sparkfrontier.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, query, label):
    got = query(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    return (held.predicted == held[label]).mean(), held


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op5_quality_classifier, "quality", 0.95), (toxicity.op8_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    share, held = accuracy(spark, query, label)
    assert len(held) > 50 and share >= least
    assert held.score.between(0, 1).all()


def test_scores_repeat(spark):
    one, two = (toxicity.op8_toxicity(spark, SF).toPandas().sort_values("doc_id").score.tolist() for _ in range(2))
    assert one == two
