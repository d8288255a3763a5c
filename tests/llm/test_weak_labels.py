"""op7: vote patterns against single texts, expectation-maximisation against a plain one, agreement with labels, odd input."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import text as tx
from textloom.llm import weak_labels as wl

SF = "/root/testdata/sf0.01"


def test_vote_counts(documents, texts):
    want = Counter(int(wl.pattern(wl.votes(tx.as_chunk(pa.array([t]))))[0]) for t in texts.values())
    assert {r.pattern: r.n for r in wl.vote_counts(documents).collect()} == want


def test_estimate_against_plain_rounds():
    """Single documents in a loop instead of counted patterns in arrays."""
    rng = np.random.default_rng(1)
    good = rng.random(400) < 0.7
    v = np.array([[(g if rng.random() < 0.85 else not g) if rng.random() < 0.9 else 2 for _ in range(5)] for g in good], int)
    patterns, counts = np.unique(v @ 3 ** np.arange(5), return_counts=True)
    got = wl.estimate(patterns, counts.astype(float), 5, rounds=7)
    prior = np.array([[3.0, 1, 1], [1, 3, 1]])
    tables, share = [prior / 5] * 5, 0.7
    for _ in range(7):
        total, sums = 0.0, [prior * max(1.0, 0.4) for _ in range(5)]
        for row in v:
            p = [1 - share, share]
            for j, x in enumerate(row):
                p = [p[c] * tables[j][c][x] for c in (0, 1)]
            p = np.array(p) / sum(p)
            total += p[1]
            for j, x in enumerate(row):
                sums[j][:, x] += p
        tables, share = [s / s.sum(1, keepdims=True) for s in sums], (total + 1) / 402
    assert got.share == pytest.approx(share, abs=1e-6)
    assert got.tables == pytest.approx(np.array(tables), abs=1e-6)
    assert ((got.posterior(v) > 0.5) == good).mean() > 0.9


def test_agrees_with_labels(spark):
    rows = wl.classify(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)


def test_odd(odd, empty, clashing):
    rows = wl.classify(odd).collect()
    assert len(rows) == odd.count() and len({(r.votes, r.score) for r in rows if r.doc_id in (8, 9)}) == 1
    assert wl.classify(empty).collect() == [] and wl.classify(clashing).count() == 8
