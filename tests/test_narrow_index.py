"""The index of a query's terms: the same numbers as the whole one, from one reading of the texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as c
from textloom.operators import evaluation as e
from textloom.operators import retrieval as r
from textloom.operators import shards

DOCS = [(1, "a b a c a b"), (2, "x y"), (3, "b\nA c </s> b"), (4, None), (5, " \n"), (6, "c")]
TERMS = ["a", "b", "zz"]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    def written(df, what):
        df.write.parquet(path := str(tmp_path_factory.mktemp("shared") / what))
        return spark.read.parquet(path)

    with pytest.MonkeyPatch.context() as patch:  # a session's folder can't be set any more
        patch.setattr(shards, "kept", written)
        docs = spark.createDataFrame(DOCS, "doc_id long, text string")
        yield docs, r.Index.of(c.doc_vectors(c.tokens(docs))), r.Index.of_terms(docs, TERMS)


def rows(df):
    return sorted(tuple(x) for x in df.select(*sorted(df.columns)).collect())


def test_same_numbers(both):
    docs, whole, narrow = both
    known = F.col("term").isin(TERMS)
    assert rows(narrow.vectors) == rows(whole.vectors.filter(known)) and rows(narrow.vocab) == rows(whole.vocab.filter(known))
    assert rows(narrow.lengths) == rows(whole.lengths) and rows(narrow.stats) == rows(whole.stats)
    assert rows(narrow.hits) == rows(c.tokens(docs, only=TERMS))
    about = narrow.about(docs, docs.filter("doc_id = 3"))
    assert rows(about.vocab) == rows(whole.vocab.filter("term IN ('a', 'b', 'c')").select("term", "cf"))


def test_scores_do_not_tokenise_again(spark, both):
    topics = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1)], "qid int, q_pos int, term string, qtf int")
    _, whole, narrow = both
    scored = r.mrf(narrow, narrow.hits, topics)
    assert "regexp_replace" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got, want = ({tuple(x[:2]): x[2] for x in rows(df)} for df in (scored, r.mrf(whole, narrow.hits, topics)))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("ordered", [True, False])
def test_phrase_counts(spark, both, ordered):
    topics = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1)], "qid int, q_pos int, term string, qtf int")
    want = {1: 2} if ordered else {1: 3, 3: 1}
    assert {x.doc_id: x.n for x in r.phrase_counts(both[2].hits, topics, 2, ordered).collect()} == want


def test_rank_change_with_ties(spark):
    first = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.9), (1, 4, 0.1)], "qid int, doc_id long, score double")
    second = spark.createDataFrame([(1, 2, 0.8), (1, 4, 0.7), (1, 9, 0.7), (1, 1, 0.1)], "qid int, doc_id long, score double")
    got = e.rank_change(first, second, 3)
    assert {(x.doc_id, x.rank_2, x.rank_1, x.change) for x in got.collect()} == {(2, 1, 3, 2), (4, 2, 4, 2), (9, 3, None, None)}
