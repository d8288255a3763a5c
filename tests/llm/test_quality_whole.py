"""op1 and the pipeline's quality stage: results don't depend on how many bigrams tasks hold."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from textloom.llm import quality


@pytest.mark.parametrize("most", [0, 300])
def test_scores_of_bigrams_that_tasks_do_not_hold(documents, monkeypatch, most):
    """Bigrams beyond the bound are counted and scored just the same."""
    twice = documents.union(documents.limit(20)).repartition(3)
    want = sorted(quality.rules(twice).collect(), key=str)
    monkeypatch.setattr(quality, "GRAMS", most)
    got = sorted(quality.rules(twice).collect(), key=str)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for a, b in zip(got, want):
        assert a[8:] == pytest.approx(b[8:], abs=1.1 / 1024, rel=2e-3)


def test_pipeline_stage_keeps_the_same_documents(spark, documents, monkeypatch):
    """The stage's verdicts rest on all bigrams of two or more too; rows come with all their columns."""
    rng = random.Random(8)
    mixed = [(50_000 + r.doc_id, " ".join(rng.sample(r.text.split(), len(r.text.split()))), r.lang, r.source, r.n_chars) for r in documents.filter("n_chars > 800").orderBy("doc_id").limit(60).collect()]
    docs = documents.union(spark.createDataFrame(mixed, documents.schema)).repartition(3)
    want = sorted(corpus_pipeline.apply_quality_rules(spark, docs, "").collect(), key=str)
    assert 0 < len(want) < docs.count()
    monkeypatch.setattr(quality, "GRAMS", 300)
    assert sorted(corpus_pipeline.apply_quality_rules(spark, docs, "").collect(), key=str) == want
