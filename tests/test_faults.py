"""Faults that no query showed: ids, run lines, empty and zero inputs, deep trees, long keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import similarity as s
from textloom.functions import text as t
from textloom.functions import vector as v
from textloom.operators import corpus, evaluation, ml, string_search
from textloom.sources import readers


def test_ids_are_dense_under_small_advisory_sizes(spark):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        vocab = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("term"), (F.col("id") % 97).alias("cf"), F.lit("x" * 50).alias("wide"))
        ids = sorted(r.term_id for r in corpus.with_ids(vocab, F.desc("cf")).select("term_id").collect())
        assert ids == list(range(60_000))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)


def test_run_lines(spark):
    rows = readers.run_lines(spark.createDataFrame([(1, 7, 0.5), (1, 8, 1.25), (2, 7, 3.0)], "qid int, doc_id int, score double"), "run")
    assert sorted(r.value for r in rows.collect()) == ["1 Q0 7 2 0.500000 run", "1 Q0 8 1 1.250000 run", "2 Q0 7 1 3.000000 run"]


def test_between(spark):
    row = spark.createDataFrame([("a(b)c(d)e", "none", "(open", ")x(y)")], "a string, b string, c string, d string").select(*(t.between(F.col(c), "(", ")").alias(c) for c in "abcd")).first()
    assert tuple(row) == ("b", None, None, "y")


def test_zero_and_empty(spark):
    df = spark.createDataFrame([("", "", None)], "a string, b string, n string")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    row = df.select(s.char_dice(a, b), s.char_jaccard(a, b), s.set_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), s.edit_similarity(a, b), s.edit_similarity(a, n)).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 1.0, None)
    z = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(v.unit(F.col("v")), v.probabilities(F.col("v")), v.softmax(F.col("v"))).first()
    assert tuple(z) == ([0.0, 0.0], [0.0, 0.0], [0.5, 0.5])


def test_evaluation_of_queries_without_relevant_or_retrieved_documents(spark):
    run = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "qid int, doc_id long, score double")
    qrels = spark.createDataFrame([(1, 1, 0), (2, 5, 1)], "qid int, doc_id long, rel int")
    rows = {r.qid: r for r in evaluation.evaluate(run, qrels).collect()}
    assert (rows[1].ap, rows[1].r_n, rows[1].retrieved) == (0.0, 0.0, 2)
    assert (rows[2].ap, rows[2].relevant, rows[2].retrieved) == (0.0, 1, 0)
    same = evaluation.compare(evaluation.evaluate(run, qrels), evaluation.evaluate(run, qrels)).first()
    assert same.improvement is None and same.t is None


def test_span_f1_without_spans(spark):
    row = ml.span_f1(spark.createDataFrame([(1, 1, "O", "O")], "seq int, pos int, gold string, found string")).first()
    assert (row.gold, row.found, row.precision, row.recall, row.f1) == (0, 0, 0.0, 0.0, 0.0)


def test_jaro_counts_whole_transpositions():
    assert s.jaro("MARTHA", "MARHTA") == pytest.approx((1 + 1 + 5 / 6) / 3)
    assert s.jaro("abcd", "bcad") == pytest.approx((1 + 1 + 3 / 4) / 3)  # three places differ: one transposition


def test_deep_trees_and_long_keys(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)], "parent long, child long")
    depths = {r.node: r.depth for r in readers.tree_depths(spark, edges).collect()}
    assert depths == {i: i for i in range(46)}
    key = "k" * 100
    row = string_search.longest_prefix(spark.createDataFrame([(key,), ("k",)], "key string"), spark.createDataFrame([(key + "z",)], "word string")).first()
    assert row.longest == key


def test_hangul(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0xAC00, 0xD7A4)) for _ in range(20)) + " a b", "", "ᄀ alone", "plain text"]
    import unicodedata

    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.hangul_decomposed(F.col("x")).alias("d"), t.hangul_composed(t.hangul_decomposed(F.col("x"))).alias("c")).collect()
    for r in rows:
        assert r.d == unicodedata.normalize("NFD", r.x) and r.c == r.x
