"""Operators whose memory or longest task must not grow with their tables, against brute force."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ml
from textloom.operators import string_search as ss


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(zip(row, row[1:], b), lambda left, z: min(left + 1, z[1] + 1, z[0] + (z[2] != x)), initial=i))
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2])
def test_edit_join_of_repeated_and_short_names(spark, tau):
    names = ["", "a", "ab", "ba", "abc", "abd", "name#0012", "name#0021", "name#0013", "nam#0012", "name#00122", "xame#0112"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate([*names, *names])], "id long, text string")
    right = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*names, None])], "id long, text string")
    got = ss.edit_join(left, right, tau=tau, q=3)
    want = {(i, 100 + j, edits(a, b)) for i, a in enumerate([*names, *names]) for j, b in enumerate(names) if edits(a, b) <= tau}
    assert {(r.left_id, r.right_id, r.distance) for r in got.collect()} == want
    assert plan(got).count("SortMergeJoin") >= 3  # by hash or gram, and to both tables: whatever a small file says of their size


def test_search_of_repeated_names(spark):
    strings = spark.createDataFrame([(i, ["red ring", "red bolt", "red rings", None][i % 4]) for i in range(60)], "id long, text string")
    got = ss.search(strings, spark.createDataFrame([(1, "red ring")], "qid int, text string"), top_k=20)
    rows = sorted((r["rank"], r.id, r.score) for r in got.collect())
    assert [i for _, i, _ in rows] == [*range(0, 60, 4), *range(2, 22, 4)]
    assert [k for k, _, _ in rows] == list(range(1, 21))
    assert "SortMergeJoin" in plan(got)


def test_clusters_without_a_matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)) + 1.2 * np.repeat(rng.normal(size=(40, 16)), 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    of = ml.clusters_of(x[:2000], np.ones(2000), 0.9, "average")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8 / 2 and (of <= np.arange(2000)).all()


def test_word_vectors_train_in_parts(spark):
    docs = spark.createDataFrame([("a b a c\nb a",), ("A b rare",), (None,)], "text string").select("text", F.lit(1).alias("x"))
    model = ml.word_vectors(docs, least=2, share=4)
    assert {r.word for r in model.getVectors().collect()} == {"a", "b"}
    assert model.getNumPartitions() == 5


def test_segmentations_count_grams_once(spark):
    from textloom.operators import feedback as f

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    df = f.segmentations(docs, spark.createDataFrame([("a b",)], "phrase string"), 3)
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Generate explode(array_distinct" in x or "array_distinct" in x for x in lines) == 1
