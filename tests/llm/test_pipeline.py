"""The pipeline: each stage's decisions against the operators and a plain near-duplicate search; odd and empty tables."""

from __future__ import annotations

import pytest

from textloom.llm import language_id, quality
from textloom.llm import spark as sp

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def run(spark, docs):
    stages = [docs]
    for name, stage in pipeline.STAGES:
        stages.append(sp.written(stage(spark, stages[-1], SF), f"test-{name}"))
    return stages


def shingles(text):
    import re

    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, documents):
    docs, known, good, kept, packed = run(spark, documents)
    assert all(x.columns == docs.columns for x in (known, good, kept))
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in (docs, known, good, kept, packed)]
    named = docs.selectExpr("doc_id", "text", "lang")
    model = language_id.train(named)
    assert ids[1] == {r.doc_id for r in language_id.identify(named, model, ["doc_id"]).filter("NOT rejected").collect()}
    assert ids[2] == {r.doc_id for r in quality.rules(known).filter("kept").collect()}
    rows = sorted(((r.doc_id, shingles(r.text)) for r in good.select("doc_id", "text").collect()))
    least = {d: d for d, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    assert ids[3] == {d for d in least if root(d) == d}
    assert ids[4] == ids[3]


def test_odd_and_empty(spark, odd, empty):
    for docs in (odd, empty):
        stages = run(spark, docs)
        counts = [x.count() for x in stages[:4]]
        assert counts == sorted(counts, reverse=True)
