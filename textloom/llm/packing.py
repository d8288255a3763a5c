"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Each task packs blocks of its own partition, so nothing is shuffled.  A document
longer than a window gives full windows of its own; what is left of it, and every
shorter document, is an item.  A block's items start as partial partitions with
one filled subset each.  The two partial partitions with the largest spreads are
merged again and again, largest subset with smallest, so that their imbalances
cancel out, until one remains: near-equal windows.  Where a window exceeds its
capacity, the window count rises and the items are differenced anew.  Where it has
risen by the padding allowed and items are still too large to share windows, the
excess of the overfull windows is cut off and fills the room of the others.

Defined cases: a null or empty text is its end id alone; repeated rows and null
ids are packed like others; an empty table gives an empty one; other columns don't
matter.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import spark as sp
from . import text as tx
from .units import tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Partial:
    """A partial partition into k subsets, by falling sums; subsets are linked lists of items."""

    __slots__ = ("head", "sums", "tail")

    def __init__(self, sums, head, tail):
        self.sums, self.head, self.tail = sums, head, tail

    @classmethod
    def single(cls, size: int, item: int, k: int) -> _Partial:
        sums, head = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], head[0] = size, item
        return cls(sums, head, head.copy())

    @property
    def spread(self) -> int:
        return int(self.sums[0] - self.sums[-1])

    def merge(self, other: _Partial, following: np.ndarray) -> _Partial:
        head, tail = other.head[::-1], other.tail[::-1]
        both = np.flatnonzero((self.head >= 0) & (head >= 0))
        following[self.tail[both]] = head[both]
        sums = self.sums + other.sums[::-1]
        order = np.argsort(-sums, kind="stable")
        return _Partial(sums[order], np.where(self.head >= 0, self.head, head)[order], np.where(head >= 0, tail, self.tail)[order])


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items in k near-equal windows."""
    following = np.full(len(sizes), -1, np.int64)
    heap = [(-int(n), i, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    full = lambda x: x if isinstance(x, _Partial) else _Partial.single(int(sizes[x]), x, k)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = full(a).merge(full(b), following)
        heapq.heappush(heap, (-merged.spread, n, merged))
        n += 1
    out = []
    for i in full(heap[0][2]).head.tolist() if heap else []:
        out.append([])
        while i >= 0:
            out[-1].append(i)
            i = int(following[i])
    return out


def fitted(sizes: np.ndarray, capacity: int, most: int) -> list[list[int]]:
    """Windows within their capacity, as few as differencing finds; ``most`` windows, some overfull, if it takes more."""
    total = int(sizes.sum())
    k = -(-total // capacity)
    while True:
        windows = difference(sizes, k)
        fullest = max(int(sizes[w].sum()) for w in windows)
        if fullest <= capacity or k >= most:
            return windows
        # the count rises to where the fullest window fits, if it stays as far above the mean
        room = capacity - (fullest - total / k)
        k = min(most, max(k + 1, math.ceil(total / room) if room > 0 else most))


def pack(lengths: np.ndarray, capacity: int, padding: float = 0.01) -> tuple[np.ndarray, ...]:
    """Packs documents of the given lengths: document, start, length, window and offset of each piece.

    padding: windows over the least number, as a share of it (at least one), before items are cut.
    """
    doc, start, size = [], [], []
    whole = []  # pieces that fill a window
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity
        for k in range(full):
            whole.append((d, k * capacity))
        if n % capacity:
            doc.append(d)
            start.append(full * capacity)
            size.append(n % capacity)
    windows: list[list[int]] = []
    if size:
        least = -(-sum(size) // capacity)
        windows = fitted(np.array(size), capacity, least + max(1, int(padding * least)))

        def cut(i: int, room: int) -> int:
            """What is beyond the first ``room`` ids of a piece, as a piece of its own."""
            doc.append(doc[i])
            start.append(start[i] + room)
            size.append(size[i] - room)
            size[i] = room
            return len(size) - 1

        over = []
        for w in windows:
            excess = sum(size[i] for i in w) - capacity
            while excess > 0:
                i = w.pop()
                if size[i] > excess:
                    w.append(i)
                    i = cut(i, size[i] - excess)
                over.append(i)
                excess -= size[i]
        for w in windows if over else ():
            room = capacity - sum(size[i] for i in w)
            while over and room:
                i = over.pop()
                if size[i] > room:
                    over.append(cut(i, room))
                w.append(i)
                room -= size[i]
    window = np.zeros(len(size), np.int64)
    offset = np.zeros(len(size), np.int64)
    used = 0
    for w in windows:
        at = 0
        for i in w:
            window[i], offset[i] = used, at
            at += size[i]
        used += bool(w)
    n = len(whole)
    return (
        np.concatenate([np.array([d for d, _ in whole], np.int64), np.array(doc, np.int64)]),
        np.concatenate([np.array([s for _, s in whole], np.int64), np.array(start, np.int64)]),
        np.concatenate([np.full(n, capacity), np.array(size, np.int64)]),
        np.concatenate([used + np.arange(n), window]),
        np.concatenate([np.zeros(n, np.int64), offset]),
    )


def pack_tokens(docs: DataFrame, tokenizer_path: str, kind: str = "word", capacity: int = 4096, end_id: int = 2, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows of at most ``capacity`` ids; ``block``: windows packed at a time."""

    def run(batches):
        tok = tokenizer(tokenizer_path, kind)
        base, used = TaskContext.get().partitionId() << 32, 0
        held, rows = [], 0

        def packed():
            nonlocal used, rows
            ids, sizes = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            names = [x for n, _, _ in held for x in n]
            at = np.cumsum(sizes) - sizes
            doc, start, length, window, offset = pack(sizes, capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = (at[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
            out = sp.batch(SCHEMA, [names[d] for d in doc.tolist()], start, length, crc, sizes[doc], base + used + window, offset)
            used += int(window.max()) + 1
            held.clear()
            rows = 0
            return out

        for batch, chunk in tx.chunks(batches, "text"):
            ids, off = tok.encode(chunk)
            ids = np.insert(ids, off[1:], end_id)
            held.append((batch.column(0).to_pylist(), ids, np.diff(off) + 1))
            rows += len(ids)
            if rows >= capacity * block:
                yield packed()
        if held:
            yield packed()

    return sp.arrow_map(sp.id_and_text(docs, id_col, text_col), run, SCHEMA)
