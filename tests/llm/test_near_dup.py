"""op4: grouping against all pairs, signatures against similarity, union-find on chains."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from textloom.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def slowly(rows, n=4, threshold=80):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(t)
    sets = {d: shingles("\n".join(sorted({x for x in t if x is not None})), n) for d, t in sets.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(docs, n=4):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dup.group(docs, shingle=n, threshold=80).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by_id == slowly(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_documents(documents):
    check(documents)


def test_five_words(documents):
    check(documents.limit(120), 5)


def test_empty_and_clashing(empty, clashing):
    assert near_dup.group(empty).collect() == []
    assert near_dup.keep_one(clashing).columns == clashing.columns
    assert near_dup.keep_one(empty).columns == empty.columns


def test_groups_chains_and_borders(spark):
    """Stars, chains whose ends aren't similar, similarities of just 0.8, and large groups of copies."""
    rng = random.Random(3)
    rows, base = [], [f"w{i}" for i in range(200)]
    for i in range(60):  # a chain: each is its predecessor, moved by three words
        rows.append((i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 80))))
    for i in range(100, 180):  # near copies of one text with different edits
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):  # exact copies, differing in case and spaces
        rows.append((i, "Exact copy OF one text  with a few words".upper() if i % 2 else "exact copy of one text with a few words"))
    for k in range(12):  # 80 and 79 percent: x of 4 * n shingles and the rest new
        a = [f"b{k}_{i}" for i in range(83)]
        cut = 16 + k % 3
        rows += [(300 + 2 * k, " ".join(a)), (301 + 2 * k, " ".join(a[:-cut]))]
    rows += [(400, None), (401, ""), (402, "  "), (403, "one two"), (404, "ONE  two"), (405, "one two three"), (None, "exact copy of one text with a few words")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_repeated_ids(spark, odd):
    check(odd)
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (None, "a b c d e f g", 3)], "doc_id long, text string, extra int")
    kept = near_dup.keep_one(docs)
    assert sorted((r.doc_id or 0, r.extra) for r in kept.collect()) == [(0, 3), (1, 1)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(400 * share), np.uint64)
            rest = (400 - len(both)) // 2
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rest, np.uint64)])) for _ in range(2))
            sign = near_dup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 100)
            errors.append((sign[0] == sign[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (1, 2, 50, 700, 3)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    together = near_dup.superminhash(np.concatenate(sets), off, 100)
    for i, s in enumerate(sets):
        assert (near_dup.superminhash(s, np.array([0, len(s)]), 100)[0] == together[i]).all()


@pytest.mark.parametrize("n", [2, 40])
def test_union_find_of_a_chain(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200), (200, 100), (300, 300)], "a long, b long")
    got = {r.node: r.least for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {200: 100}
