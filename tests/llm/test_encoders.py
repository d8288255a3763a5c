"""op3 and op10: ids, digests and records against the libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import merges, records, sentencepiece_bpe, units
from textloom.llm import spark as sp
from textloom.llm import text as tx
from textloom.llm.queries import tokenizer_path

PIECES, BYTES, WORDS = (tokenizer_path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
ANY = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("aeinst ' \n\tABC019.,▁é ", max_size=60), min_size=1, max_size=6)


def chunk_of(texts):
    import pyarrow as pa

    return tx.as_chunk(pa.array(texts, pa.string()))


def by_library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_pieces(documents, odd):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (documents, odd):
        got = Counter(tuple(r) for r in sentencepiece_bpe.encode_digests(docs, PIECES).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "")
            want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
        assert got == want


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_pieces_of_any_text(texts):
    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.model(PIECES)
    ids, off = m.encode(chunk_of(texts))
    decoded = m.decode(ids, off)
    for i, t in enumerate(texts):
        want = lib.encode(t)
        assert ids[off[i] : off[i + 1]].tolist() == want
        assert decoded[i] == lib.decode(want)


@settings(max_examples=150, deadline=None)
@given(ANY)
@pytest.mark.parametrize("path,kind", [(BYTES, "byte"), (WORDS, "word")])
def test_units_of_any_text(path, kind, texts):
    lib = by_library(path)
    ids, off = units.tokenizer(path, kind).encode(chunk_of(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == lib(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=14), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_rounds_are_sequential_merging(words, rng):
    """Simultaneous leftmost merges against one merge at a time, with a made-up table."""
    pairs, n = {}, 5
    for rank in range(12):
        pairs.setdefault((rng.randrange(n), rng.randrange(n)), (rank, n))
        n += 1
    table = merges.MergeTable(pairs)

    def slowly(w):
        w = list(w)
        while True:
            best = min(((pairs[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in pairs), default=None)
            if not best:
                return w
            i = best[1]
            w[i : i + 2] = [pairs[w[i], w[i + 1]][1]]

    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    sym, to = table.merge(np.concatenate(words).astype(np.int64), off)
    assert [sym[a:b].tolist() for a, b in zip(to, to[1:])] == [slowly(w) for w in words]
    assert [table.merge_one(w) for w in words] == [slowly(w) for w in words]


def read_back(docs):
    folder = sp.scratch(docs.sparkSession, "records")
    files = records.write(docs, folder, BYTES)
    return folder, files, records.read(files, folder).collect()


def test_records(documents, odd):
    lib = by_library(BYTES)
    for docs in (documents, odd):
        _, _, rows = read_back(docs)
        ids = {}
        for r in docs.select("doc_id", "text").collect():
            ids.setdefault(r.doc_id, []).append([*lib(r.text or ""), 2])
        start = 0
        for r in sorted(rows, key=lambda r: r.start):
            want = ids[r.doc_id][0]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
            start += len(want)
        assert len(rows) == sum(map(len, ids.values()))
        in_order = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
        assert in_order == sorted(in_order)


def test_damage_is_found(clashing):
    folder, files, rows = read_back(clashing)
    assert len(rows) == 8
    name = files.first().file
    path = f"{folder}/{name}.rec".removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        records.read(files, folder).collect()


def test_crc_by_bits():
    def slowly(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert slowly(b"123456789") == 0xE3069283
    data = np.random.default_rng(2).integers(0, 256, 4000, np.uint8)
    start, size = np.array([0, 3, 100, 500]), np.array([4, 64, 65, 3500])
    assert records.crc32c(data, start, size).tolist() == [slowly(data[a : a + n].tobytes()) for a, n in zip(start, size)]


def test_empty(empty):
    assert sentencepiece_bpe.encode_digests(empty, PIECES).collect() == []
    assert read_back(empty)[2] == []
