"""op1: base counts against plain Python, the n-gram model against a direct one, verdicts."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import quality
from textloom.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def check(docs, rows):
    got = sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)))
    want = sorted(map(str, ((r.doc_id, *plain(r.text)) for r in docs.select("doc_id", "text").collect())))
    assert got == want
    assert all(not r.kept for r in rows if r.base_failed)


def test_counts(documents):
    check(documents, quality.rules(documents).collect())


def test_odd(odd):
    check(odd, quality.rules(odd).collect())


def test_empty_and_clashing(empty, clashing):
    assert quality.rules(empty).collect() == []
    assert quality.keep_good(empty).collect() == []
    assert quality.rules(clashing).count() == 8
    assert quality.keep_good(clashing).columns == clashing.columns


def split(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]


def test_bigram_counts_and_model(documents, texts):
    """Counts against dictionaries, modified Kneser-Ney values against a direct computation, and sums of one."""
    model = quality.train(documents)
    words = Counter(w for t in texts.values() for w in split(t))
    assert len(model.words.keys) == sum(n >= 3 for n in words.values())
    head = {w for w, n in words.items() if n >= 3}
    tails = {}
    for w in words:
        chunk = tx.as_chunk(pa.array([w]))
        key, _ = quality.word_keys(chunk)
        tails[w] = int(model.words.symbols(key)[0])
        assert (tails[w] < quality.HEAD) == (w in head)
    grams, types = Counter(), Counter(s for w, s in tails.items())
    for t in texts.values():
        line = [quality.BORDER, *(tails[w] for w in split(t)), quality.BORDER]
        grams.update(zip(line, line[1:]) if len(line) > 2 else [])
    kept = {g: n for g, n in grams.items() if n >= 2}
    assert dict(zip(((int(k) >> quality.BITS, int(k) & (1 << quality.BITS) - 1) for k in model.keys), model.n.tolist())) == kept
    n1, n2, n3, n4 = (sum(n == k for n in grams.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    discount = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    before = Counter(b for _, b in grams)
    after = Counter()
    for (a, _), n in grams.items():
        after[a] += n
    lower = lambda b: ((before[b] - 0.75 if before[b] else 0) + 0.75 * len(before) / (quality.BORDER + 1)) / len(grams)
    rng = np.random.default_rng(1)
    some = [list(grams)[i] for i in rng.integers(0, len(grams), 300)] + [(tails[a], tails[b]) for a, b in zip(rng.choice(sorted(tails), 100), rng.choice(sorted(tails), 100))]
    log, alone = model.logs(np.array([a << quality.BITS | b for a, b in some], np.uint64))
    for (a, b), got, got_lower in zip(some, log, alone):
        gamma = 1 - sum(n - discount[min(n, 3)] for (x, _), n in kept.items() if x == a) / after[a] if after[a] else 1
        c = kept.get((a, b), 0)
        want = ((c - discount[min(c, 3)]) / after[a] if c else 0) / max(types[b], 1) + gamma * lower(b) / max(types[b], 1)
        assert got == pytest.approx(math.log(want), abs=1e-6)
        assert got_lower == pytest.approx(math.log(lower(b) / max(types[b], 1)), abs=1e-6)
    for a in (some[0][0], quality.BORDER, quality.HEAD + 5):
        every = np.arange(quality.BORDER + 1)
        assert (np.exp(model.logs((a << quality.BITS | every).astype(np.uint64))[0]) * model.words.types).sum() == pytest.approx(1, abs=1e-9)


def test_scores_without_own_counts(documents, texts):
    """A text that stands once in the corpus gains no more than it would from the other texts' bigrams."""
    rows = {r.doc_id: r for r in quality.rules(documents.repartition(3)).collect()}
    model = quality.train(documents)
    for d in sorted(texts)[:20]:
        line = [quality.BORDER, *(int(model.words.symbols(quality.word_keys(tx.as_chunk(pa.array([w])))[0])[0]) for w in split(texts[d])), quality.BORDER]
        if len(line) == 2:
            continue
        grams = list(zip(line, line[1:]))
        own, first = Counter(grams), Counter(line[:-1])
        log = [model.logs(np.array([a << quality.BITS | b], np.uint64), np.array([own[a, b]]), np.array([first[a]]))[0][0] for a, b in grams]
        assert rows[d].entropy == pytest.approx(-sum(log) / len(log), abs=1e-3)


def test_bands_reject_noise_and_keep_prose(spark, documents):
    """Random letters fall out of their language's band; most clean documents stay in."""
    rng = np.random.default_rng(5)
    noise = [(10_000 + i, " ".join("".join(rng.choice(list("qxzjkvwq"), 7)) for _ in range(200)), "en", "n", 0) for i in range(5)]
    flat = [(20_000 + i, " ".join(f"{'e' * (1 + (i + k) % 9)}{k}" for k in range(120)), "en", "n", 0) for i in range(3)]
    rows = {r.doc_id: r for r in quality.rules(documents.unionByName(spark.createDataFrame(noise + flat, documents.schema))).collect()}
    assert not any(rows[d].kept for d, *_ in noise)
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1").collect()}
    passed = [rows[d] for d in good if not rows[d].base_failed]
    assert sum(r.kept for r in passed) >= 0.98 * len(passed)
    assert all(math.isfinite(r.entropy) for r in passed)


def test_words_in_no_order_are_rejected(spark):
    """Words of good documents, shuffled: four characters can't tell, the words can."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    good = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1"), "doc_id").filter("n_chars > 1500").orderBy("doc_id").limit(100).collect()
    rng = np.random.default_rng(3)
    mixed = [(1_000_000 + i, " ".join(rng.permutation(r.text.split())), r.lang, r.source, 0) for i, r in enumerate(good)]
    rows = {r.doc_id: r for r in quality.rules(docs.unionByName(spark.createDataFrame(mixed, docs.schema))).collect()}
    passed = [rows[d] for d, *_ in mixed if not rows[d].base_failed]
    assert sum(not r.kept for r in passed) >= 0.6 * len(passed)
    passed = [rows[r.doc_id] for r in good if not rows[r.doc_id].base_failed]
    assert sum(r.kept for r in passed) >= 0.95 * len(passed)


def test_hashes_of_spans_of_any_length():
    """Equal spans hash alike wherever they stand; a changed, added or moved byte changes the hash."""
    rng = np.random.default_rng(2)
    seen = {}
    for size in (0, 1, 7, 8, 9, 15, 16, 17, 64, 4096, 4097, 100_000):
        span = rng.integers(0, 256, size, np.uint8)
        for before in (0, 3):
            buf = np.concatenate([np.full(before, 7, np.uint8), span, np.full(5, 9, np.uint8)])
            h = int(tx.hashes(buf, np.array([before]), np.array([before + size]))[0])
            assert seen.setdefault(h, span.tobytes()) == span.tobytes()
        for other in ([np.append(span, 0)] if size else []) + ([np.roll(span, 8)] if size > 8 else []):
            assert int(tx.hashes(other.astype(np.uint8), np.array([0]), np.array([len(other)]))[0]) not in seen
