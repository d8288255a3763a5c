"""Vectorised byte-pair merging of many words at once.

The symbols of all words lie in one flat array.  A round takes the minimum rank
of the adjacent pairs inside each word (a segmented minimum), merges that pair at
all its leftmost, non-overlapping places in all words at the same time, compacts
the array and ranks only the pairs that changed.  Rounds end when no pair with a
rank remains.

Sequential merging takes the best pair, leftmost first, and may then find a pair
with the new symbol that is better still.  Symbols for which the vocabulary has
such a pair are marked ``alone``: of their places only the first in each word is
merged in a round, so that the result is the sequential one.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Ranks and results of pairs, in an open-addressing table of numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """pairs: (left, right) -> (rank, merged); a lower rank goes first, equal ranks go from the left."""
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        rank, merged = (np.array([v[k] for v in pairs.values()], np.int32) for k in (0, 1))
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << bits, NONE, np.int32), np.full(1 << bits, -1, np.int32)
        key = left << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[slot[todo]] == -1
            took = np.unique(slot[todo[free]], return_index=True)[1]
            now = todo[free][took]
            self.key[slot[now]], self.rank[slot[now]], self.merged[slot[now]] = key[now], rank[now], merged[now]
            todo = np.setdiff1d(todo, now)
            busy = self.key[slot[todo]] != -1
            slot[todo[busy]] = slot[todo[busy]] + 1 & self.mask
        n = int(max([0, *merged, *left, *right])) + 1
        own = np.full(n, NONE, np.int32)
        np.minimum.at(own, merged, rank)
        worst = np.full(n, -1, np.int64)
        np.maximum.at(worst, merged, rank)
        self.alone = np.zeros(n, bool)
        for side in (left, right):
            better = rank <= worst[side]
            self.alone[side[better]] = True
        counts = np.unique(rank, return_counts=True)
        shared = np.isin(rank, counts[0][counts[1] > 1])
        first = np.full(int(rank.max()) + 1 if len(rank) else 1, -1, np.int32)
        first[rank] = merged
        self.alone[merged[shared & (first[rank] != merged)]] = True
        self.alone[first[rank[shared & (first[rank] != merged)]]] = True
        self.pairs = pairs

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair, or -1."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, slot, -1)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            found = self.key[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (found != -1)]
        return out

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One word, sequentially with a heap: for very long words, whose rounds would be many."""
        sym, n = list(symbols), len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (p := self.pairs.get((sym[i], sym[right[i]]))):
                heapq.heappush(heap, (p[0], i, sym[i], sym[right[i]], p[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = to, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i])
            push(i)
        return [s for s in sym if s >= 0]

    def merge(self, sym: np.ndarray, off: np.ndarray, long: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of each word; returns symbols and offsets. Symbols must be non-negative."""
        n = len(off) - 1
        size = np.diff(off)
        done_sym, done_word = [], []
        for w in np.flatnonzero(size > long):
            got = np.array(self.merge_one(sym[off[w] : off[w + 1]].tolist()), np.int64)
            done_sym.append(got)
            done_word.append(np.full(len(got), w))
        word = np.repeat(np.arange(n), size)
        keep = (size <= long)[word]
        sym, word = sym[keep].astype(np.int64), word[keep]
        last = np.ones(len(sym), bool)
        last[:-1] = word[1:] != word[:-1]
        slot = np.full(len(sym), -1)
        inner = np.flatnonzero(~last)
        slot[inner] = self.look(sym[inner], sym[inner + 1])
        rank = np.where(slot >= 0, self.rank[slot], NONE)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            open_ = least != NONE
            if not open_.all():
                stay = np.repeat(open_, size)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, slot, rank = sym[stay], word[stay], slot[stay], rank[stay]
                if not len(sym):
                    break
                least, size = least[open_], size[open_]
                starts = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # of places that overlap every second one counts, from the left
            run = np.concatenate([[True], np.diff(hit) != 1])
            if not run.all():
                nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[nth % 2 == 0]
            to = self.merged[slot[hit]].astype(np.int64)
            alone = self.alone[to]
            if alone.any():
                first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
                # in a word whose first place is alone, or that has another place that is alone, only the first is merged
                some = np.zeros(n, bool)
                some[word[hit[alone]]] = True
                keep = first | ~some[word[hit]]
                hit, to = hit[keep], to[keep]
            sym[hit] = to
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            index = np.cumsum(stay) - 1
            sym, word, slot, rank = sym[stay], word[stay], slot[stay], rank[stay]
            at = index[hit]
            changed = np.concatenate([at, at[at > 0] - 1])
            inner = changed[changed + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            slot[changed], rank[changed] = -1, NONE
            found = self.look(sym[inner], sym[inner + 1])
            slot[inner] = found
            rank[inner] = np.where(found >= 0, self.rank[found], NONE)
        sym = np.concatenate([np.zeros(0, np.int64), *done_sym])
        word = np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
