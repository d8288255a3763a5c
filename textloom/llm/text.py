"""Vectorised text primitives: whole record batches as flat numpy arrays.

A batch of texts is handled as one flat ``uint8`` buffer plus document offsets,
so that splitting, hashing and counting are array operations and never a Python
loop over words.  Batches are cut into chunks by *bytes*, which bounds memory
whatever the lengths of the texts; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: The separators of ``[^\x20\x09-\x0D]+``.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks that keep the first n bytes of a little-endian 64-bit word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACE = np.uint64(0x9DDFEA08EB382D69)


@dataclass
class Chunk:
    """Texts as one buffer; document ``i`` is ``buf[off[i]:off[i + 1]]``."""

    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def lower(self) -> Chunk:
        """A-Z lower-cased, every other byte as it is."""
        return Chunk(_LOWER[self.buf], self.off)

    def doc(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a chunk in order; those of document ``i`` are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def as_chunk(texts: pa.Array) -> Chunk:
    """Null texts become empty ones."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Chunk(buf, off - off[0])


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Slices of the batches of about ``most`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = as_chunk(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(whole.off, whole.off[at] + most, "right")) - 1)
            off = whole.off[at : to + 1]
            yield batch.slice(at, to - at), Chunk(whole.buf[off[0] : off[-1]], off - off[0])
            at = to


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values that end at document borders: starts, ends, index of each document's first."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = np.flatnonzero(np.diff(off))
    head, tail = off[full], off[full + 1] - 1
    first[head] = member[head]
    last[tail] = member[tail]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def words(chunk: Chunk) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return Words(*spans(_WORD[chunk.buf], chunk.off))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, of whatever length; equal spans hash alike in every process.

    Blocks of eight bytes are mixed with their place and summed up, so all blocks of all spans are handled at once.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(buf) + 1, np.dtype("<u8"), padded, strides=(1,))
    out = mix64(eights[start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64)
    rest = np.flatnonzero(size > 8)
    if len(rest):
        blocks = (size[rest] - 1) // 8  # after the first one
        first = np.cumsum(blocks) - blocks
        k = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
        at = np.repeat(start[rest], blocks) + 8 * k
        block = eights[at] & _KEEP[np.minimum(np.repeat(end[rest], blocks) - at, 8)]
        out[rest] += np.add.reduceat(mix64(block ^ _PLACE * k.astype(np.uint64)), first)
    return mix64(out)


def ngrams(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` word hashes inside a document, and the index of each one's first word."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(word) - n + 1
    out = word[:total].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += word[k : k + total]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(word))
    at = np.flatnonzero(left[:total] >= n)
    return mix64(out[at]), at


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the values of each document (``off``: index of each one's first value)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each span's value, and for each distinct value a span that holds it."""
    code, value = pd.factorize(hashes(buf, start, end))
    where = np.empty(len(value), np.int64)
    where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, where


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start[i] .. start[i] + size[i] - 1`` of all i, in order."""
    to = np.cumsum(size)
    index = np.arange(int(to[-1]) if len(to) else 0)
    index += np.repeat(start - (to - size), size)
    return index
