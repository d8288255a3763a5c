"""Counting 64-bit keys of a whole corpus in shards.

Each task counts its own keys and sends them to shards by hash, as sorted arrays: differences of
neighbours in byte planes, whose upper ones are mostly zero and compress away.  A shard adds up
what all tasks sent.  A key is sent once a task at most, so frequent keys don't make a shard hot;
the number of shards grows with what is counted, so a shard stays small.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spark as sp
from . import text as tx

SENT = "shard int, keys binary, times binary"
#: Distinct keys that a task holds before it sends what it has.
MOST = 3_000_000


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def tight(data: bytes) -> bytes:
    """Compressed, with its length before it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loose(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Tight:
    """An object whose arrays (of one dimension) are compressed as byte planes while it is sent; those in order as differences."""

    IN_ORDER = ("keys",)

    def __getstate__(self) -> dict:
        def sent(name: str, x):
            if not isinstance(x, np.ndarray):
                return x
            gaps = np.diff(x, prepend=x.dtype.type(0)) if name in self.IN_ORDER else np.ascontiguousarray(x)
            return x.dtype.str, tight(gaps.view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""

        return {name: sent(name, x) for name, x in vars(self).items()}

    def __setstate__(self, state: dict) -> None:
        for name, x in state.items():
            if isinstance(x, tuple):
                kind = np.dtype(x[0])
                x = np.ascontiguousarray(np.frombuffer(loose(x[1]) if x[1] else b"", np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
                x = np.cumsum(x, dtype=kind) if name in self.IN_ORDER else x
            setattr(self, name, x)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n, begin)


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (tx.mix64(keys) % np.uint64(shards)).astype(np.int32)


def sent(docs: DataFrame, keys_of: Callable[[tx.Chunk], np.ndarray], shards: int, text: str = "text", shard_of: Callable[[np.ndarray, int], np.ndarray] = shards_of) -> DataFrame:
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, n = summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            keys, n, cut = keys[order], n[order], np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cut)):
                a, b = cut[k], cut[k + 1]
                yield sp.batch(SENT, [k], [pack(keys[a:b])], [pack_counts(n[a:b])])

        for _, chunk in tx.chunks(batches, text):
            keys, n = np.unique(keys_of(chunk), return_counts=True)
            held.append((keys, n.astype(np.int64)))
            if sum(len(k) for k, _ in held) > MOST:
                yield from out()
        if held:
            yield from out()

    return sp.arrow_map(docs.select(text), run, SENT)


def count(docs: DataFrame, keys_of: Callable[[tx.Chunk], np.ndarray], shards: int, schema: str, made: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], text: str = "text", shard_of: Callable[[np.ndarray, int], np.ndarray] = shards_of) -> DataFrame:
    """What ``made`` makes of each shard's keys (in order) and their counts in all texts."""

    def add(rows: pa.Table) -> pa.Table:
        parts = [(unpack(k.as_py()), unpack_counts(n.as_py())) for k, n in zip(rows["keys"], rows["times"])]
        out = pa.Table.from_batches([made(*summed(*(np.concatenate(x) for x in zip(*parts))))])
        sp.give_back()
        return out

    # as many partitions as shards, whatever the session's setting
    return sent(docs, keys_of, shards, text, shard_of).repartition(shards, "shard").groupBy("shard").applyInArrow(add, sp.schema_of(schema))


ROWS = "key long, n long"


def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return sp.batch(ROWS, keys.view(np.int64), n)
