"""Batch encoding with tokenizers of the tokenizers library, once per distinct unit.

A tokenizer's pre-tokens never cross certain borders of white space.  Texts are
cut there into *units*, each distinct unit is encoded once, and the ids of a text
are gathered from its units.  Units of ASCII and Latin-1 letters without
apostrophes are merged in vectorised rounds with the tokenizer's own merges, read
through the library; all other units, and whole texts in which the borders are in
doubt (white space beyond ASCII), are encoded by the library.  Ids are those of
the library on the whole text.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from . import text as tx
from .merges import MergeTable

#: White space beyond ASCII, as UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|\xef\xbb\xbf")


class Memory:
    """Ids of units seen before; the number of units kept is bounded."""

    def __init__(self, most: int = 120_000):
        self.most, self.index, self.end = most, {}, np.zeros(1, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def take(self, keys: list[bytes], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and each key's start and length there."""
        if len(self.index) > self.most:
            self.__init__(self.most)
        known = self.index
        new = [k for k in keys if k not in known]
        if new:
            ids, size = encode(new)
            at = len(known)
            known.update(zip(new, range(at, at + len(new))))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.end = np.concatenate([self.end, self.used + np.cumsum(size)])
            self.used += len(ids)
        where = np.fromiter((known[k] for k in keys), np.int64, len(keys))
        return self.ids, self.end[where], self.end[where + 1] - self.end[where]


def _put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` behind the entries used; it grows when it is full."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(len(more), used), array.dtype)])
    array[used : used + len(more)] = more
    return array


class UnitMemory:
    """Ids of units seen before, found by hash and then held against their bytes; the number of units kept is bounded.

    When there are too many, those that weren't found again go, and beyond half of the bound those found least often.
    """

    def __init__(self, most: int = 250_000):
        self.most, self.n = most, 0
        self._keep(np.zeros(0, np.int64))

    def _keep(self, unit: np.ndarray) -> None:
        """Forgets all units but these."""
        if not len(unit):
            self.hash, self.unit, self.found = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << 10, np.int32)
            self.data, self.begin, self.ids, self.end, self.n = np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64), 0
            return
        data, begin, ids, end = self.data, self.begin, self.ids, self.end
        size, count = begin[unit + 1] - begin[unit], end[unit + 1] - end[unit]
        self.data, self.ids = data[tx.expand(begin[unit], size)], ids[tx.expand(end[unit], count)]
        self.begin, self.end = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(count)])
        place = np.full(self.n, -1)
        place[unit] = np.arange(len(unit))
        stays = place[self.unit] >= 0
        self.hash, self.unit, self.n = self.hash[stays], place[self.unit[stays]], len(unit)
        self.found = np.zeros(len(unit), np.int32)

    def _known(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether spans are these units, byte by byte."""
        same = size == self.begin[unit + 1] - self.begin[unit]
        at = np.flatnonzero(same)
        differ = buf[tx.expand(start[at], size[at])] != self.data[tx.expand(self.begin[unit[at]], size[at])]
        same[at] = tx.per_doc(differ, np.concatenate([[0], np.cumsum(size[at])])) == 0
        return same

    def take(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and each span's start and length there. The spans' hashes differ."""
        if self.n > self.most:
            again = np.flatnonzero(self.found[: self.n])
            self._keep(np.sort(again[np.argsort(-self.found[again], kind="stable")[: self.most // 2]]))
        key = tx.hashes(buf, start, end)
        order = np.argsort(key)
        key, start, size = key[order], start[order], (end - start)[order]
        at = np.searchsorted(self.hash, key)
        hit = at < len(self.hash)
        hit[hit] = self.hash[at[hit]] == key[hit]
        seen = np.flatnonzero(hit)
        seen = seen[self._known(buf, start[seen], size[seen], self.unit[at[seen]])]
        unit = np.full(len(key), -1)
        unit[seen] = self.unit[at[seen]]
        self.found[unit[seen]] += 1
        new = np.flatnonzero(unit < 0)
        if len(new):
            raw = buf.tobytes()
            ids, count = encode([raw[a:b] for a, b in zip(start[new].tolist(), (start + size)[new].tolist())])
            data, n = buf[tx.expand(start[new], size[new])], self.n
            self.data, self.ids = _put(self.data, self.begin[n], data), _put(self.ids, self.end[n], ids)
            self.begin, self.end = _put(self.begin, n + 1, self.begin[n] + np.cumsum(size[new])), _put(self.end, n + 1, self.end[n] + np.cumsum(count))
            self.found = _put(self.found, n, np.zeros(len(new), np.int32))
            unit[new] = n + np.arange(len(new))
            self.n += len(new)
            fresh = new[~hit[new]]  # of units with one hash only the first is found again
            self.hash, self.unit = np.insert(self.hash, at[fresh], key[fresh]), np.insert(self.unit, at[fresh], unit[fresh])
        out = np.empty(len(unit), np.int64)
        out[order] = unit
        return self.ids, self.end[out], self.end[out + 1] - self.end[out]


#: Classes of bytes in plain units: letters, digits, others, space; 0 where a unit isn't plain.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0xC3] = _CLASS[0x80:0xC0] = 1
_CLASS[0x27] = 0
_CLASS[0x20] = 4


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class UnitTokenizer:
    """Ids of whole texts, from the ids of their distinct units."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.memory = UnitMemory()
        spec = json.loads(self.library.to_str())["model"]
        vocab, end = spec["vocab"], spec.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.first = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int64)
        pairs = {}
        for rank, pair in enumerate(spec["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.table = MergeTable(pairs)
        self.lower, self.digits_apart = False, False

    def plain(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain units by merge rounds: which units are plain, their ids, how many each has."""
        buf = np.frombuffer(b"".join(units), np.uint8)
        size = np.fromiter(map(len, units), np.int64, len(units))
        off = np.concatenate([[0], np.cumsum(size)])
        kind = _CLASS[buf]
        second = np.zeros(len(buf), bool)
        second[1:] = buf[:-1] == 0xC3
        bad = (kind == 0) | ((buf == 0xC3) & np.append(~((buf[1:] >= 0x80) & (buf[1:] < 0xC0)), True)) | ((buf >= 0x80) & (buf < 0xC0) & ~second) | (second & ((buf == 0x97) | (buf == 0xB7)))
        is_plain = (tx.per_doc(bad, off) == 0) & (size > 0)
        keep = np.repeat(is_plain, size)
        buf, kind, second, size = buf[keep], kind[keep], second[keep], size[is_plain]
        if not len(buf):
            return is_plain, np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.lower:
            up = (buf >= 0x41) & (buf <= 0x5A) | second & (buf >= 0x80) & (buf <= 0x9E)
            buf = np.where(up, buf + np.uint8(0x20), buf)
        off = np.concatenate([[0], np.cumsum(size)])
        start = np.ones(len(buf), bool)
        start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 4) | (kind[1:] == 2) & self.digits_apart
        start[off[:-1]] = True
        token = np.flatnonzero(start)
        to = np.append(token[1:], len(buf))
        sym = self.first[buf]
        sym[to - 1] = self.last[buf[to - 1]]
        ids, ends = [], []
        for a in range(0, len(token), 20_000):
            b = min(a + 20_000, len(token))
            got, end = self.table.merge(sym[token[a] : to[b - 1]], np.append(token[a:b], to[b - 1]) - token[a])
            ids.append(got)
            ends.append(np.diff(end))
        return is_plain, np.concatenate(ids).astype(np.int32), tx.per_doc(np.concatenate(ends), np.searchsorted(token, off))

    def encode_all(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        is_plain, ids, size = self.plain(units)
        if is_plain.all():
            return ids, size
        rest = np.flatnonzero(~is_plain)
        more, more_size = self.encode_units([units[i] for i in rest])
        sizes = np.zeros(len(units), np.int64)
        sizes[is_plain], sizes[rest] = size, more_size
        at = np.zeros(len(units), np.int64)
        at[is_plain], at[rest] = np.cumsum(size) - size, len(ids) + np.cumsum(more_size) - more_size
        return np.concatenate([ids, more])[tx.expand(at, sizes)], sizes

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and the index of each document's first."""
        raise NotImplementedError

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All their ids, and how many each has."""
        raise NotImplementedError

    def encode(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a chunk's documents, and the offset of each document's first id."""
        start, end, first = self.units(chunk)
        code, where = tx.distinct(chunk.buf, start, end)
        flat, at, size = self.memory.take(chunk.buf, start[where], end[where], self.encode_all)
        size_of = size[code]
        ids = flat[tx.expand(at[code], size_of)]
        off = np.concatenate([[0], np.cumsum(size_of)])[first]
        if _WIDE.search(chunk.buf.tobytes()):
            ids, off = self._with_direct(chunk, ids, off)
        return ids, off

    def _with_direct(self, chunk: tx.Chunk, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[off[i] : off[i + 1]] for i in range(chunk.n)]
        odd = [i for i in range(chunk.n) if _WIDE.search(chunk.doc(i))]
        for i, found in zip(odd, self.direct([chunk.doc(i).decode("utf-8", "replace") for i in odd])):
            parts[i] = np.array(found, np.int32)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


class ByteLevel(UnitTokenizer):
    """Byte-level BPE whose pre-tokens are words with at most one space before them, or runs of white space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.width = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
        for token, i in self.library.get_vocab().items():
            self.width[i] = len(token)
        self.newline = self.direct(["a\nb"])[0][1:2]

    def units(self, chunk):
        buf, off = chunk.buf, chunk.off
        start, end, first = tx.spans(tx._WORD[buf], off)
        gap, gap_end, _ = tx.spans(~tx._WORD[buf], off)
        # a word takes the space just before it; of other white space before a word, the last character stands alone
        spaced = (start > 0) & (buf[np.maximum(start - 1, 0)] == 0x20)
        spaced[np.isin(start, off)] = False
        if len(gap):
            before_word = np.isin(gap_end, start) & ~np.isin(gap_end, off)
            took = before_word & (buf[gap_end - 1] == 0x20)
            rest = gap_end - before_word
            lone = before_word & ~took
            blank = rest > gap
            starts = np.concatenate([start - spaced, gap[blank], rest[lone]])
            ends = np.concatenate([end, rest[blank], gap_end[lone]])
            order = np.argsort(starts, kind="stable")
            start, end = starts[order], ends[order]
            first = np.searchsorted(start, off)
        return start, end, first

    def encode_units(self, units):
        ids, size = [None] * len(units), np.zeros(len(units), np.int64)
        blank = [i for i, u in enumerate(units) if u.isspace()]
        spaced = [i for i, u in enumerate(units) if u[:1] == b" " and not u.isspace()]
        plain = [i for i, u in enumerate(units) if u[:1] != b" " and not u.isspace()]
        for i, found in zip(blank, self.direct([units[i].decode() for i in blank])):
            ids[i] = np.array(found, np.int32)
        groups = [(spaced[k : k + 512], b"") for k in range(0, len(spaced), 512)] + [(plain[k : k + 512], b"\n") for k in range(0, len(plain), 512)]
        for (group, glue), found in zip(groups, self.direct([glue.join(units[i] for i in g).decode("utf-8", "replace") for g, glue in groups])):
            found = np.array(found, np.int32)
            at = np.concatenate([[0], np.cumsum(self.width[found])])
            length = np.array([len(units[i]) for i in group])
            to = np.cumsum(length + len(glue)) - len(glue)
            a, b = np.searchsorted(at, to - length), np.searchsorted(at, to)
            sure = (at[np.minimum(a, len(at) - 1)] == to - length) & (at[np.minimum(b, len(at) - 1)] == to)
            for k, i in enumerate(group):
                ids[i] = found[a[k] : b[k]] if sure[k] else np.array(self.direct([units[i].decode("utf-8", "replace")])[0], np.int32)
        size[:] = [len(x) for x in ids]
        return np.concatenate([np.zeros(0, np.int32), *ids]), size


class WordLevel(UnitTokenizer):
    """BPE that drops white space: words are encoded on their own."""

    MARK = "\x01"

    def __init__(self, path: str):
        super().__init__(path)
        self.lower = self.digits_apart = True
        found = self.direct([self.MARK])[0]
        self.mark = found[0] if len(found) == 1 else None

    def units(self, chunk):
        return tx.spans(tx._WORD[chunk.buf], chunk.off)

    def encode_units(self, units):
        text = [u.decode("utf-8", "replace") for u in units]
        alone = [i for i, t in enumerate(text) if self.mark is None or self.MARK in t]
        ids = [None] * len(units)
        for i, found in zip(alone, self.direct([text[i] for i in alone])):
            ids[i] = np.array(found, np.int32)
        rest = [i for i, x in enumerate(ids) if x is None]
        groups = [rest[k : k + 512] for k in range(0, len(rest), 512)]
        glue = f" {self.MARK} "
        for group, found in zip(groups, self.direct([glue.join(text[i] for i in g) for g in groups])):
            parts = np.array(found, np.int32)
            cut = np.flatnonzero(parts == self.mark)
            if len(cut) != len(group) - 1:
                parts_of = [np.array(x, np.int32) for x in self.direct([text[i] for i in group])]
            else:
                parts_of = [parts[a + 1 : b] for a, b in zip([-1, *cut.tolist()], [*cut.tolist(), len(parts)])]
            for i, x in zip(group, parts_of):
                ids[i] = x
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)


_KEPT: dict[tuple, UnitTokenizer] = {}


def tokenizer(path: str, kind: str) -> UnitTokenizer:
    """A tokenizer kept by this worker. kind: ``byte`` or ``word``."""
    key = (path, kind)
    if key not in _KEPT:
        _KEPT[key] = {"byte": ByteLevel, "word": WordLevel}[kind](path)
    return _KEPT[key]
