"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Reads the model file itself (pieces, scores, normaliser settings) and encodes
distinct words with :class:`~textloom.llm.merges.MergeTable`.  A word is a run of
spaces with what follows it, cut also around characters that no longer piece
holds, since no merge crosses those borders.  Models whose normaliser isn't the
identity, that aren't BPE, or whose pieces have a space inside or user symbols
are refused.

Defined cases: null and empty texts have no ids and decode to an empty text;
repeated rows have equal values; other columns don't matter; an empty table gives
an empty one; a very long word is merged with a heap instead of rounds.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from . import spark as sp
from . import text as tx
from .merges import MergeTable
from .units import Memory

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, ids array<int>, decoded string"


def _fields(data: bytes):
    """Fields of a protocol-buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            at += size
            yield tag >> 3, data[at - size : at]


def _spaced(chunk: tx.Chunk) -> tx.Chunk:
    """The chunk with a space for each U+2581, which has the same pieces."""
    buf = chunk.buf
    at = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return chunk
    buf = buf.copy()
    buf[at] = 0x20
    keep = np.ones(len(buf), bool)
    keep[at + 1] = keep[at + 2] = False
    return tx.Chunk(buf[keep], np.concatenate([[0], np.cumsum(keep)])[chunk.off])


class Model:
    """A BPE model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        trainer, norm = ({k: v for n, m in top if n == at for k, v in _fields(m)} for at in (2, 3))
        self.text = [p[1].decode() for p in pieces]
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        kind = [p.get(3, 1) for p in pieces]
        inside = any(SPACE in t.lstrip(SPACE) for t, k in zip(self.text, kind) if k == 1)
        if norm.get(1) != b"identity" or norm.get(4, 1) or norm.get(2) or trainer.get(3) != 2 or inside or {4, 5} & set(kind):
            raise ValueError("this model's normaliser, type or pieces aren't supported")
        self.prefix = bool(norm.get(3, 1))
        piece = {t: i for i, (t, k) in enumerate(zip(self.text, kind)) if k == 1}
        # equal scores have equal ranks
        order = {s: i for i, s in enumerate(sorted({score[i] for i in piece.values()}, reverse=True))}
        pairs = {}
        for whole, i in piece.items():
            for k in range(1, len(whole)):
                a, b = piece.get(whole[:k]), piece.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[score[i]], i)
        self.table = MergeTable(pairs)
        self.n = len(pieces)
        #: Of each code point: its piece, or -1; and whether a longer piece has it.
        self.single = np.full(0x110000, -1, np.int32)
        self.joins = np.zeros(0x110000, bool)
        for t, i in piece.items():
            if len(t) == 1:
                self.single[ord(t)] = i
            else:
                self.joins[[ord(c) for c in t]] = True
        #: ASCII characters that are words of their own.
        self.lone = np.concatenate([~self.joins[:128], np.zeros(128, bool)])
        self.lone[0x20] = False
        self.byte = np.full(256, kind.index(2) if 2 in kind else 0, np.int32)
        for i, (t, k) in enumerate(zip(self.text, kind)):
            if k == 6:
                self.byte[int(t[3:5], 16)] = i
        out = [b"" if k == 3 else bytes([int(t[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kind)]
        self.out, self.width = np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out])
        self.out_at = np.cumsum(self.width) - self.width
        self.number = [str(i).encode() for i in range(self.n)]
        self.memory = Memory()

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: all ids, and how many each word has."""
        data = b"".join(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        heads = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int8) >= -64)])
        size = np.diff(heads[np.concatenate([[0], np.cumsum(size)])])
        points = np.frombuffer(data.decode("utf-8", "replace").replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        sym = self.single[points]
        sym = np.where(sym < 0, points.astype(np.int64) + self.n, sym)  # unknown characters: beyond all pieces
        sym, off = self.table_merge(sym, np.concatenate([[0], np.cumsum(size)]))
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):  # unknown characters become the ids of their bytes
            as_bytes = [chr(c - self.n).encode() for c in sym[odd].tolist()]
            wide = np.ones(len(sym), np.int64)
            wide[odd] = [len(b) for b in as_bytes]
            to = np.concatenate([[0], np.cumsum(wide)])
            ids = np.repeat(sym, wide)
            ids[tx.expand(to[odd], wide[odd])] = self.byte[np.frombuffer(b"".join(as_bytes), np.uint8)]
            sym, off = ids, to[off]
        return sym.astype(np.int32), np.diff(off)

    def table_merge(self, sym, off):
        parts = [self.table.merge(sym[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in ((k, min(k + 20_000, len(off) - 1)) for k in range(0, len(off) - 1, 20_000))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        base = np.cumsum([0, *(len(s) for s, _ in parts)])
        return np.concatenate([s for s, _ in parts]), np.concatenate([[0], *(o[1:] + b for (_, o), b in zip(parts, base))])

    def prepare(self, chunk: tx.Chunk) -> tx.Chunk:
        """The texts with a space put before each that isn't empty, and spaces for the sign that stands for a space."""
        chunk = _spaced(chunk)
        full = np.diff(chunk.off) > 0
        if not self.prefix:
            return chunk
        return tx.Chunk(np.insert(chunk.buf, chunk.off[:-1][full], 0x20), chunk.off + np.concatenate([[0], np.cumsum(full)]))

    def cut(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of a prepared chunk: starts, ends, index of each document's first."""
        buf = chunk.buf
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk.off), np.int64)
        start = np.zeros(len(buf) + 1, bool)
        blank = buf == 0x20
        start[1:-1] = blank[1:] & ~blank[:-1]
        lone = np.flatnonzero(self.lone[buf])
        start[lone] = True
        start[lone + 1] = True
        start[chunk.off[:-1][np.diff(chunk.off) > 0]] = True
        at = np.flatnonzero(start[:-1])
        return at, np.append(at[1:], len(buf)), np.searchsorted(at, chunk.off)

    def encode(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a chunk's documents, and the offset of each document's first id."""
        ready = self.prepare(chunk)
        start, end, first = self.cut(ready)
        code, where = tx.distinct(ready.buf, start, end)
        raw = ready.buf.tobytes()
        flat, at, size = self.memory.take([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())], self.encode_words)
        size = size[code]
        return flat[tx.expand(at[code], size)], np.concatenate([[0], np.cumsum(size)])[first]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of ids, without the space that encoding put before them; bytes that aren't UTF-8 become U+FFFD."""
        width = self.width[ids]
        data = self.out[tx.expand(self.out_at[ids], width)].tobytes()
        to = np.concatenate([[0], np.cumsum(width)])[off].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(to, to[1:])]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


_KEPT: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _KEPT:
        _KEPT[path] = Model(path)
    return _KEPT[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and the text decoded from them."""

    def run(batches):
        m = model(model_path)
        for rows, chunk in tx.chunks(batches, "text"):
            ids, off = m.encode(chunk)
            import pyarrow as pa

            yield sp.batch(IDS_SCHEMA, rows.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())), m.decode(ids, off))

    return sp.arrow_map(sp.id_and_text(docs, id_col, text_col), run, IDS_SCHEMA)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, SHA-256 of its decimal ids and of the decoded text."""

    def run(batches):
        m = model(model_path)
        number = np.array(m.number, object)
        for rows, chunk in tx.chunks(batches, "text"):
            ids, off = m.encode(chunk)
            decoded = m.decode(ids, off)
            names, at = number[ids].tolist(), off.tolist()
            yield sp.batch(
                SCHEMA,
                rows.column(0),
                np.diff(off),
                [hashlib.sha256(b",".join(names[a:b])).hexdigest() for a, b in zip(at, at[1:])],
                [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
            )

    return sp.arrow_map(sp.id_and_text(docs, id_col, text_col), run, SCHEMA)
