"""Posting codecs as exact round trips."""

from __future__ import annotations

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import codecs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_round_trips(numbers):
    assert codecs.vb_decode(codecs.vb_encode(numbers)) == numbers
    assert codecs.gamma_decode(codecs.gamma_encode(numbers), len(numbers)) == numbers
    assert codecs.unary_decode(codecs.unary_encode(numbers), len(numbers)) == numbers


def test_gaps(spark):
    df = spark.createDataFrame([([3, 7, 8, 20],), ([],), ([5],)], "v array<long>")
    out = df.select(codecs.gap_encode(F.col("v")).alias("g"), "v").select("g", codecs.gap_decode(F.col("g")).alias("back"), "v").collect()
    assert [r.g for r in out] == [[3, 4, 1, 12], [], [5]]
    assert all(r.back == r.v for r in out if r.v)


def test_gaps_of_a_long_list_are_summed_once(spark):
    """Work in proportion to the list: with a sum from the start for every number this list takes minutes."""
    began = time.time()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: x % 7).cast("array<long>").alias("g"))
    back = codecs.gap_decode(F.col("g"))
    row = long.select(F.size(back).alias("n"), F.element_at(back, -1).alias("last")).first()
    assert tuple(row) == (200_000, sum(x % 7 for x in range(1, 200_001)))
    assert time.time() - began < 60
