"""op10 (and op2): units that texts have again and again are encoded once, and never taken for others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import text as tx
from textloom.llm import units
from textloom.llm.queries import tokenizer_path


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", units.ByteLevel), ("word_bpe_49k.json", units.WordLevel)])
def test_units_found_again_stay(file, kind, texts):
    tok, library, asked = kind(tokenizer_path(file)), Tokenizer.from_file(tokenizer_path(file)), []
    tok.memory.__init__(1_500)
    encode_all = tok.encode_all
    tok.encode_all = lambda keys: (asked.extend(keys), encode_all(keys))[1]
    known = [t for t in texts.values() if t][:80]
    common = "these words come in every chunk of texts"
    for k in range(0, len(known), 2):
        own = [f"{common} {x} {common}" for x in known[k : k + 2]]
        ids, off = tok.encode(tx.as_chunk(pa.array(own)))
        want = [x.ids for x in library.encode_batch_fast(own, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    words = [u.strip() for u in asked]
    assert len(set(words)) > tok.memory.most  # the memory was full at times
    spaced = [u for u in asked if u == b" every" or u == b"every"]
    assert len(spaced) == len(set(spaced))


def test_units_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tx, "hashes", lambda buf, start, end: np.full(len(start), 7, np.uint64))
    memory = units.UnitMemory()

    def encode(keys):
        return np.array([b for k in keys for b in k], np.int32), np.array([len(k) for k in keys])

    for word in (b"one", b"two", b"three", b"one", b"tw", b""):
        flat, at, size = memory.take(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), encode)
        assert flat[at[0] : at[0] + size[0]].tolist() == list(word)
