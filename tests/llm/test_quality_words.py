"""The pipeline's quality stage and op1: every word that occurs three times or more is a symbol of its own, also beyond the head."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from textloom.llm import quality
from textloom.llm import text as tx

PAIRS, TEXTS, MIXED = 70_000, 1_400, 20


@pytest.fixture(scope="module")
def many_words():
    """140,000 words with one ending, three times each and always in the same pairs, but for some texts in no order; and a word of each text's own."""
    rng = random.Random(6)
    pairs = [f"{2 * i}ion {2 * i + 1}ion" for i in range(PAIRS)] * 3
    mixed = " ".join(pairs[: 150 * MIXED]).split()
    pairs = pairs[150 * MIXED :]
    rng.shuffle(mixed)
    rng.shuffle(pairs)
    texts = [pairs[i::TEXTS] for i in range(TEXTS)] + [mixed[i::MIXED] for i in range(MIXED)]
    return [(i, " ".join([*x, f"{'abc'[i % 3]}{i}end"]), "en", "s", 0) for i, x in enumerate(texts)]


def test_stage_tells_order_by_words_beyond_the_head(spark, many_words):
    docs = spark.createDataFrame(many_words, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.apply_quality_rules(spark, docs, "").collect()}
    assert kept == set(range(TEXTS))


@pytest.mark.parametrize("most", [1 << 21, 1_000])
def test_entropies_of_words_beyond_the_head(spark, many_words, monkeypatch, most):
    """Against a direct computation, whether tasks hold the bigrams or ask for them."""
    monkeypatch.setattr(quality, "GRAMS", most)
    docs = spark.createDataFrame(many_words, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in quality.rules(docs).collect()}
    lines = {i: t.split() for i, t, *_ in many_words}
    n = Counter(w for x in lines.values() for w in x)
    assert sum(k >= 3 for k in n.values()) > quality.HEAD
    rare = [w for w in n if n[w] < 3]
    bits = quality.word_keys(tx.as_chunk(pa.array([" ".join(rare)])))[0] & np.uint64(quality.CLASSES - 1)
    symbol = {w: w for w in n} | {w: int(c) for w, c in zip(rare, bits)}
    lines = {i: ["", *(symbol[w] for w in x), ""] for i, x in lines.items()}
    grams = Counter(g for x in lines.values() for g in zip(x, x[1:]))
    types, before, total = Counter(symbol.values()), Counter(b for _, b in grams), Counter(a for x in lines.values() for a in x[:-1])
    n1, n2, n3, n4 = (sum(c == k for c in grams.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    discount = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5], [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])
    seen = Counter()
    for (a, _), c in grams.items():
        seen[a] += c - discount[min(c, 3)] if c >= 2 else 0
    symbols = sum(k >= 3 for k in n.values()) + quality.CLASSES + 1
    lower = {b: ((k - 0.75) + 0.75 * len(before) / symbols) / len(grams) / max(types[b], 1) for b, k in before.items()}
    for i in [*range(0, TEXTS, 35), *range(TEXTS, TEXTS + MIXED)]:
        own, first = Counter(zip(lines[i], lines[i][1:])), Counter(lines[i][:-1])
        log = 0.0
        for (a, b), k in own.items():
            c = max(grams[a, b] if grams[a, b] >= 2 else 0, k) - k
            p = (c - discount[min(c, 3)]) / max(total[a] - first[a], 1) / max(types[b], 1) + (1 - seen[a] / total[a]) * lower[b]
            log += k * math.log(p)
        size = len(lines[i]) - 1
        assert got[i].entropy == pytest.approx(-log / size, abs=1.1 / 1024)
        assert got[i].lower_entropy == pytest.approx(-sum(math.log(lower[b]) for b in lines[i][1:]) / size, abs=1.1 / 1024)
