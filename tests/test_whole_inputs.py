"""Queries over whole tables against brute force, where SQL is too slow or there is none."""

from __future__ import annotations

import numpy as np
import pytest

from textloom import plans
from textloom.operators import ml

SF = "/root/testdata/sf0.01"


def test_components_of_all_parts(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").filter("p_size < 20").collect()
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for r in parts:
        a, b = sorted((root(r.p_partkey), root(r.p_partkey + 7)))
        above[b] = a
    rows = [tuple(r) for r in plans.QUERIES["graph_components_all"](spark, SF).select("node", "least").collect()]
    assert sorted(rows) == sorted((x, root(x)) for x in above)
    assert max(x for x, _ in rows) >= 2000


def test_damerau_of_all_names(spark):
    names = {r.p_partkey: r for r in spark.read.parquet("/root/testdata/sf0.1/part.parquet").collect()}
    got = {r.id for r in plans.QUERIES["strings_damerau_all"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {k for k in names if k + 1 in names}
    assert any(len(names[k].p_name) >= 12 for k in got)


def plain_clusters(ids: list[int], x: np.ndarray, least: float, linkage: str) -> dict[int, int]:
    """Merges the most similar clusters, every linkage computed anew from all pairs of members."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    sim = (x / np.maximum(norm, 1e-12)) @ (x / np.maximum(norm, 1e-12)).T
    of = {"average": np.mean, "max": np.max, "min": np.min}[linkage]
    groups = [[i] for i in range(len(ids))]
    while len(groups) > 1:
        best, i, j = max((of(sim[np.ix_(groups[i], groups[j])]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if best < least:
            break
        groups[-i] += groups.pop(-j)
    return {ids[i]: min(ids[k] for k in g) for g in groups for i in g}


@pytest.mark.parametrize("linkage", ["average", "max", "min"])
def test_agglomeration_of_all_vectors(spark, linkage):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(6, 8)), 7, axis=0) + 0.45 * rng.normal(size=(42, 8))
    x = np.concatenate([x, x[:3], x[:1], np.zeros((2, 8))])
    ids = [int(i) for i in rng.permutation(len(x)) * 37]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in ml.agglomerate_all(rows, 0.5, linkage, block=9).collect()}
    assert got == plain_clusters(ids, x, 0.5, linkage)


def test_agglomeration_merges_across_labels_and_ids(spark):
    """The only pair at or above the bound at sf0.01 is far apart in label or id."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.5, 1)))]
    got = {r.id: r.cluster for r in plans.QUERIES["ml_agglomerative"](spark, SF).collect()}
    assert near and len(got) == len(ids)
    assert sum(k != c for k, c in got.items()) >= 1 and all(got[a] == got[b] for a, b in near[:1] if len(near) == 1)


def test_postings_of_all_terms(spark):
    """Every token is in some posting list, not only those of the topics."""
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES["corpus_postings_all"](spark, sf).groupBy("doc_id").agg({"tf": "sum", "term": "count"}).collect()
    want = plans.QUERIES["corpus_tokens"](spark, sf).collect()
    assert {(r.doc_id, r["sum(tf)"], r["count(term)"]) for r in got} == {(r.doc_id, r.n_tokens, r.n_types) for r in want}
