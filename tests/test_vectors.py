"""Vector search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from textloom.operators import ml


@pytest.mark.parametrize("block, query_block", [(1000, 1000), (23, 5)])
def test_nearest_is_exact(spark, block, query_block):
    x = np.random.default_rng(5).normal(size=(90, 6)).round(1)
    x[7], x[8], x[50] = x[1], x[1], 0  # ties and the zero vector
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None)], "id long, vec array<double>")
    asked = rows.filter("id % 3 = 1").withColumnRenamed("id", "qid")
    got = {}
    for r in ml.nearest(rows, asked, 4, block, query_block, tile=2).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["id"], round(r["cosine"], 9))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    cosine = (unit @ unit.T).round(9)
    for q in range(1, 90, 3):
        best = sorted((i for i in range(90) if i != q), key=lambda i: (-cosine[q, i], i))[:4]
        assert [got[q][k + 1][0] for k in range(4)] == best
        assert [got[q][k + 1][1] for k in range(4)] == pytest.approx([cosine[q, i] for i in best], abs=2e-9)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>")
    assert ml.nearest(none, some).count() == 0
    assert ml.nearest(some.withColumnRenamed("qid", "id"), some.filter("qid > 1")).count() == 0
    assert ml.nearest(some.withColumnRenamed("qid", "id"), some).count() == 0
