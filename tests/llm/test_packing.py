"""op2: pieces put back together are the library's ids; windows are gapless, full and near-equal."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing
from textloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(docs, **options):
    rows = packing.pack_tokens(docs, PATH, **options).collect()
    t, want = library(), defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 2])
    capacity = options.get("capacity", 4096)
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        for ids in want[doc]:  # equal rows of one id have equal pieces
            assert {n for *_, n in found} == {len(x) for x in want[doc]}
            if len(want[doc]) == 1:
                at = 0
                for start, length, crc, _ in sorted(found):
                    assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                    at += length
                assert at == len(ids)
        assert sum(n for _, n, *_ in found) == sum(map(len, want[doc]))
    return rows, windows


def test_documents(documents):
    rows, windows = check(documents.coalesce(1))
    total = sum(r.length for r in rows)
    assert len(windows) <= -(-total // 4096) + 1  # little padding


def test_odd_and_small_windows(odd):
    check(odd)
    check(odd, capacity=64, block=4)


def test_empty_and_clashing(empty, clashing):
    assert packing.pack_tokens(empty, PATH).collect() == []
    check(clashing)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.integers(1, 120))
def test_any_lengths(lengths, capacity):
    doc, start, size, window, offset = packing.pack(np.array(lengths), capacity)
    seen = [np.zeros(n, int) for n in lengths]
    fill = defaultdict(list)
    for d, s, n, w, o in zip(doc, start, size, window, offset):
        seen[d][s : s + n] += 1
        fill[w].append((o, n))
    assert all((x == 1).all() for x in seen)
    for w in fill.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= capacity
    least = -(-sum(lengths) // capacity)
    assert len(fill) <= least + max(1, least // 100)


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    sums = [sizes[w].sum() for w in packing.difference(sizes, 16)]
    assert sorted(i for w in packing.difference(sizes, 16) for i in w) == list(range(400))
    assert max(sums) - min(sums) <= 8


def test_count_rises_before_items_are_cut():
    lengths = np.random.default_rng(2).integers(1, 1000, 400)
    doc, start, size, window, _ = packing.pack(lengths, 4096)
    assert len(doc) == 400 and not start.any()
    doc, start, size, window, _ = packing.pack(np.full(100, 2500), 4096)  # two don't share a window
    assert len(set(window.tolist())) <= -(-250000 // 4096) + 1 and len(doc) > 100


@pytest.mark.parametrize("lengths", [[1], [4096], [4097], [8192, 1], [1] * 5000])
def test_borders(lengths):
    doc, start, size, window, offset = packing.pack(np.array(lengths), 4096)
    assert size.sum() == sum(lengths)
    assert len(set(window.tolist())) == -(-sum(lengths) // 4096)
