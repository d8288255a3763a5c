"""op8: accuracy on held-out documents, what is learned from, rejection, odd input."""

from __future__ import annotations

import zlib

import pytest

from textloom.llm import language_id


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, {r.doc_id: r for r in language_id.predict_all(docs).collect()}


def test_held_out_accuracy(predicted):
    docs, rows = predicted
    known = [r for r in docs.collect() if r.lang is not None]
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in known)
    out = [r for r in known if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_clean_documents_are_not_rejected(spark, predicted):
    _, rows = predicted
    good = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 AND toxic = 0").collect()]
    assert sum(rows[d].rejected for d in good) <= 0.01 * len(good)


def test_odd(odd):
    rows = language_id.predict_all(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for d in (1, 2, 3, 15):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].rejected) == ("und", 0.0, True)
    assert by_id[8][2:] == by_id[9][2:]


def test_empty_unlabelled_and_clashing(spark, empty, clashing):
    assert language_id.predict_all(empty).collect() == []
    assert language_id.keep_known(empty).columns == empty.columns
    kept = language_id.keep_known(clashing)
    assert kept.columns == clashing.columns and kept.dtypes == clashing.dtypes
    nothing = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict_all(nothing).collect()] == ["und"]
