"""op6: counts and base scores against dictionaries, the model against a direct computation, sums of one, odd input."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import maxent
from textloom.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(w.translate(LOWER) for w in WORD.findall(text or "")), None]  # None: the end


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check_base(docs):
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(t for r in rows if not held_out(r.doc_id) for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in maxent.score(docs).collect()), key=str)
    want = []
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want.append((str(r.doc_id), held_out(r.doc_id), len(t), sum(counts[x] > 0 for x in t), n, round(base, 6)))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-4)


def test_base_scores(documents):
    check_base(documents)


def test_odd(odd):
    check_base(odd)


def test_empty_and_clashing(empty, clashing):
    assert maxent.score(empty).collect() == []
    assert maxent.score(clashing).count() == 8


def test_model_gains_on_held_out_texts(documents):
    rows = [r for r in maxent.score(documents).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.2
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_repeated_rows_score_alike(spark, documents):
    some = documents.orderBy("doc_id").limit(60)
    once = {r.doc_id: r for r in maxent.score(some.unionByName(some.filter("doc_id % 7 = 3"))).collect()}
    for r in maxent.score(some.unionByName(some.filter("doc_id % 7 = 3"))).collect():
        assert r.n_known == once[r.doc_id].n_known
        assert r.base_score == pytest.approx(once[r.doc_id].base_score)


def words(text):
    chunk = tx.as_chunk(pa.array([text]))
    return maxent.Sequence(chunk)


def test_pairs_against_dictionaries(spark, documents, monkeypatch):
    """What pairs add to each text, from shards and from the table of top words, against plain counts without the text's own."""
    rows = documents.select("doc_id", "text").collect()
    named = documents.selectExpr("doc_id", "text").withColumn("held_out", maxent.held_out(documents.doc_id))
    lines = [tokens(r.text) for r in rows]
    training = [not held_out(r.doc_id) for r in rows]
    counts = Counter(t for line, mine in zip(lines, training) if mine for t in line)
    bucket, key = {}, {}
    for r, line in zip(rows, lines):
        seq = words(r.text)
        for t, k in zip(line, seq.key):
            bucket[t], key[t] = int(k) & 255, int(k)
    bucket_n, types = np.zeros(256), np.zeros(256)
    for t, n in counts.items():
        bucket_n[bucket[t]] += n
        types[bucket[t]] += 1
    head = {t: n for t, n in counts.items() if n >= 2}
    shares = maxent.Shares(np.array([key[t] for t in head], np.uint64), np.array(list(head.values())), bucket_n, types)
    for b in range(256):
        own = shares.log[(shares.key & np.uint64(255)) == b]
        others = sum(bucket[t] == b for t in counts if t not in head) + 1
        assert (10**own).sum() + others * 10 ** shares.other[b] == pytest.approx(1)
    held = spark.sparkContext.broadcast(shares)
    answers = maxent.told(maxent.asked(named.repartition(3), held, 5), 5).toPandas()
    cells = np.zeros(maxent.CELLS, np.int64)
    below = answers[answers["row"] < 0]
    cells[-1 - below["row"].to_numpy()] = below["value"]
    sums = answers[answers["row"] >= 0].groupby("row")["value"].sum().to_dict()
    pair, group = Counter(), Counter()
    before = lambda line: zip([0, *line], line)  # noqa: E731 - 0: a text's beginning
    for line, mine in zip(lines, training):
        for a, b in before(line) if mine else ():
            pair[a, b] += 1
            group[a, bucket[b]] += 1
    for r, line, mine in list(zip(rows, lines, training))[:60]:
        chunk = tx.as_chunk(pa.array([r.text]))
        seq = maxent.Sequence(chunk)
        p = maxent.Pairs(seq, shares)
        got = maxent.in_table(cells, p, np.zeros(len(line), np.int64), np.array([mine])).sum()
        got += sums.get(int(maxent.row_key(np.array([r.doc_id]), chunk)[0]), 0.0)
        own = Counter(before(line)) if mine else Counter()
        own_group = Counter((a, bucket[b]) for a, b in before(line)) if mine else Counter()
        want = sum(
            math.log10((pair[a, b] - own[a, b] + maxent.PRIOR * 10**log) / (group[a, bucket[b]] - own_group[a, bucket[b]] + maxent.PRIOR)) - log
            for (a, b), log in zip(before(line), p.log)
        )
        assert got == pytest.approx(want, abs=1e-6)
