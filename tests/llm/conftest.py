"""Fixtures for the operators of the optional subpackage."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("textloom.llm")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


#: Nulls, empty and odd texts, repeats of rows and ids, and one very long text and word.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\x0b\x0c ", "en", "a", 7),
    (4, "one", "en", "a", 3),
    (5, "one two three", None, "a", 13),
    (6, "Ünïcode wörds ñ ß 中文 \U0001f600 é   x y", "de", "a", 30),
    (7, "a b c d a b c d a b c d", "en", "a", 23),
    (8, "same text stands here twice or more often", "en", "a", 40),
    (9, "same text stands here twice or more often", "en", "b", 40),
    (9, "same text stands here twice or more often", "en", "b", 40),
    (10, "x" * 3000, "en", "a", 3000),
    (11, "it's DON'T  we'll\n\nI'm <|endoftext|> </s> <s> 123 4567 3.14 $5", "en", "a", 50),
    (12, "line\nline\n\nline\n  \nother\r\nother", "fr", "a", 30),
    (13, "﻿byte order mark\x00null", "fr", "a", 20),
    (None, "no id at all", "fr", "a", 12),
    (15, "...!!! ### $$$ %%%", None, None, 18),
]


@pytest.fixture(scope="session")
def odd(spark):
    rng = random.Random(4)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ωmega", "x1"]) + str(rng.randrange(400)) for _ in range(30_000))
    return spark.createDataFrame([*ODD, (16, long_text, "en", "a", len(long_text))], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns under the names that operators use inside and return."""
    names = ("kept", "key", "node", "n", "band", "lang_pred", "score", "row", "held_out", "__lang", "rejected", "component_id", "n_words", "doc id", "a.b")
    rows = [(i, f"some words of document {i} and a few more that all of them have in common", "en", "s", 50, *range(len(names))) for i in range(8)]
    return spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"`{n}` long" for n in names))
