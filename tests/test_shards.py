"""Counts by chunks and shards against plain counts, over texts in several chunks."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from textloom.operators import corpus as c
from textloom.operators import mining as m

_R = random.Random(5)
TEXTS = ["\n".join(" ".join(_R.choice(["a", "b", "c", "The", "é", "</s>", "x."]) for _ in range(_R.randint(0, 9))) for _ in range(_R.randint(1, 4))) for _ in range(60)] + [None, "", " \n\n ", "\ta  b\r\n\nb\x0bc\n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(7)


def grams(text, lengths):
    lines = [line.split() for line in (text or "").lower().split("\n")]
    return [" ".join(line[i : i + n]) for line in lines for n in lengths for i in range(len(line) - n + 1)]


def rows_of_words(df) -> bool:
    """Whether the plan makes a row of each word or sorts them by document."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate" in plan or "Window" in plan


def test_frequent_phrases(docs):
    n, df = Counter(), Counter()
    for t in TEXTS:
        found = grams(t, (2, 3, 4))
        n.update(found)
        df.update(set(found))
    got = m.frequent_phrases(docs, 4, 4)
    assert not rows_of_words(got)
    want = {(p, len(p.split(" ")), k, df[p]) for p, k in n.items() if k >= 4}
    assert {tuple(r) for r in got.select("phrase", "words", "n", "df").collect()} == want and want


@pytest.mark.parametrize("symmetric", [True, False])
def test_cooccurrence(docs, symmetric):
    n, weight = Counter(), Counter()
    for t in TEXTS:
        words, pos = [], 0
        for line in ((t or "").lower()).split("\n"):
            for w in line.split():
                if w != "</s>":
                    words.append((pos, w))
                pos += 1
            pos += bool(line.split())
        for i, (p, a) in enumerate(words):
            for q, b in words[i + 1 :]:
                if q - p <= 3:
                    for pair in ((a, b), (b, a)) if symmetric else ((a, b),):
                        n[pair] += 1
                        weight[pair] += 1 / (q - p)
    df = c.cooccurrence(docs, 3, 5, symmetric=symmetric)
    assert not rows_of_words(df)
    got = {(r.left, r.right): (r.n, r.weight) for r in df.collect()}
    assert set(got) == {p for p, k in n.items() if k >= 5}
    assert all(k == n[p] and w == pytest.approx(weight[p]) for p, (k, w) in got.items())


def test_keyphrases(docs):
    stop = ["a", "b"]
    n, df = Counter(), Counter()
    for t in TEXTS:
        n.update(grams(t, (2, 3)))
        df.update(set(grams(t, (2, 3))))
    good = {p for p, k in n.items() if k >= 3 and not p.startswith("<") and p[-1] not in ".>" and set(p.split()) - set(stop)}
    total = sum(bool((t or "").split()) for t in TEXTS)
    want = set()
    for i, t in enumerate(TEXTS):
        score = {p: k * math.log((total + 1) / df[p]) for p, k in Counter(grams(t, (2, 3))).items() if p in good}
        best = sorted(score, key=lambda p: (-round(score[p], 9), p))[:5]
        want |= {(i, p, round(score[p], 6), k) for k, p in enumerate(best, 1)}
    assert {(r.doc_id, r.phrase, round(r.score, 6), r["rank"]) for r in m.keyphrases(docs, stop).collect()} == want and want
