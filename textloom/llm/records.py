"""Length-delimited binary records of token ids, with an offset index.

Files of framed records in ascending order of document id.  A record is framed as
``length (u64), masked CRC-32C of the length, payload, masked CRC-32C of the
payload``, all little-endian; this is the framing of TensorFlow's record files.  A
payload is ``document id (i64), flags (u8: 1 null id, 2 wide ids), ids (u16, or u32
if one doesn't fit)``.  Beside each file stands an index of fixed-size entries
(``offset, length, document id, ids``), by which records can be read in any order.

Tasks write files under names of their own in the shared folder and report them; a
task that is run again writes another file, and only reported ones are read.

Defined cases: a null or empty text has the end id alone; null document ids come
first; repeated rows are records of their own; an empty table has no files.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spark as sp
from . import text as tx
from .units import tokenizer

FILES = "part int, file string, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc", "<i8"), ("tokens", "<u8")])
_LANE = 64


@lru_cache(1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1)
    return table


def _zeros(crc: np.ndarray, n: int) -> np.ndarray:
    table = _byte_table()
    for _ in range(n):
        crc = crc >> np.uint32(8) ^ table[crc & np.uint32(255)]
    return crc


@lru_cache(1)
def _places() -> np.ndarray:
    """What a byte at each place of a lane adds to the lane's CRC."""
    out = [_byte_table()]
    for _ in range(_LANE - 1):
        out.append(_zeros(out[-1], 1))
    return np.array(out[::-1])


@lru_cache(64)
def _shift(power: int) -> np.ndarray:
    """Tables by which a CRC moves past ``2 ** power`` lanes of zeros."""
    if power == 0:
        basis = _zeros(np.uint32(1) << np.arange(32, dtype=np.uint32), _LANE)
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                table[byte, np.arange(256) >> bit & 1 == 1] ^= basis[byte * 8 + bit]
        return table
    half = _shift(power - 1)
    return np.array([_apply(half, row) for row in half])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc32c(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of spans of at least four bytes, all at once.

    A CRC is linear: each byte's part is looked up by its place in a lane of 64
    bytes, and the lanes of a span are moved to their places and added.
    """
    if not len(size):
        return np.zeros(0, np.uint32)
    lanes = -(-size // _LANE)
    first = np.cumsum(lanes) - lanes
    begin = (first + lanes) * _LANE - size  # zeros in front don't change it
    flat = np.zeros(int(lanes.sum()) * _LANE, np.uint8)
    flat[tx.expand(begin, size)] = data[tx.expand(start, size)]
    for k in range(4):
        flat[begin + k] ^= 255
    flat = flat.reshape(-1, _LANE)
    crc = np.zeros(len(flat), np.uint32)
    for k, table in enumerate(_places()):
        crc ^= table[flat[:, k]]
    behind = np.repeat(first + lanes, lanes) - 1 - np.arange(len(crc))
    for power in range(int(behind.max()).bit_length()):
        on = np.flatnonzero(behind >> power & 1)
        crc[on] = _apply(_shift(power), crc[on])
    return np.bitwise_xor.reduceat(crc, first) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)).astype("<u4")


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed records, and the length of each payload."""
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    body = np.frombuffer(b"".join(payloads), np.uint8)
    heads = size.astype("<u8").view(np.uint8)
    eight = np.full(len(size), 8)
    head_crc = masked(crc32c(heads, np.arange(len(size)) * 8, eight)).view(np.uint8).reshape(-1, 4)
    body_crc = masked(crc32c(body, np.cumsum(size) - size, size)).view(np.uint8).reshape(-1, 4)
    at = np.cumsum(size + 16) - size - 16
    out = np.empty(int((size + 16).sum()), np.uint8)
    out[at[:, None] + np.arange(8)] = heads.reshape(-1, 8)
    out[at[:, None] + np.arange(8, 12)] = head_crc
    out[tx.expand(at + 12, size)] = body
    out[(at + 12 + size)[:, None] + np.arange(4)] = body_crc
    return out.tobytes(), size


def unframe(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Checks the frames of records; raises if one is damaged."""
    length = data[at[:, None] + np.arange(8)].reshape(-1).view("<u8")
    head = data[at[:, None] + np.arange(8, 12)].reshape(-1).view("<u4")
    body = data[(at + 12 + size)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    if (length != size).any() or (masked(crc32c(data, at, np.full(len(at), 8))) != head).any() or (masked(crc32c(data, at + 12, size)) != body).any():
        raise ValueError("a record's length or checksum is wrong")


def write(docs: DataFrame, folder: str, tokenizer_path: str, kind: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes record files and indexes, and returns the table of files, in order of their ids."""

    def run(batches):
        tok = tokenizer(tokenizer_path, kind)
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        index, tokens, at, out = [], 0, 0, None
        for batch, chunk in tx.chunks(batches, "text"):
            ids, off = tok.encode(chunk)
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            narrow = ids.astype("<u2").tobytes()
            names = batch.column(0).to_pylist()
            wide = np.maximum.reduceat(ids, off[:-1]) > 0xFFFF
            payloads = []
            for doc, a, b, w in zip(names, off[:-1].tolist(), off[1:].tolist(), wide.tolist()):
                head = (doc or 0).to_bytes(8, "little", signed=True) + bytes([(doc is None) | w << 1])
                payloads.append(head + (ids[a:b].astype("<u4").tobytes() if w else narrow[2 * a : 2 * b]))
            data, size = frame(payloads)
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.rec")
            out.write(data)
            entry = np.zeros(len(size), INDEX)
            entry["offset"], entry["length"] = at + np.cumsum(size + 16) - size - 16, size
            entry["doc"], entry["tokens"] = [x or 0 for x in names], np.diff(off)
            index.append(entry)
            at += len(data)
            tokens += len(ids)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.concatenate(index).tobytes())
            yield sp.batch(FILES, [part], [name], [sum(map(len, index))], [tokens], [at])

    ordered = sp.id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return sp.written(sp.arrow_map(ordered, run, FILES), "record-files")


def read(files: DataFrame, folder: str, step: int = 4 << 20) -> DataFrame:
    """Reads record files back through their indexes: per record its place, length and checksum of ids."""
    spark = files.sparkSession
    rows = sorted(files.select("part", "file", "tokens").collect())  # one row per written file
    starts, total = [], 0
    for _, name, tokens in rows:
        starts.append((name, total))
        total += tokens
    named = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)), F.rand(7)) if starts else spark.createDataFrame([], "file string, start long")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                first = start + np.concatenate([[0], np.cumsum(index["tokens"].astype(np.int64))])
                ends = (index["offset"] + index["length"]).astype(np.int64) + 16
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    k = 0
                    while k < len(index):
                        offset = int(index["offset"][k])
                        to = max(k + 1, int(np.searchsorted(ends, offset + step, "right")))
                        raw = f.read_at(int(ends[to - 1]) - offset, offset)
                        at, size = index["offset"][k:to].astype(np.int64) - offset, index["length"][k:to].astype(np.int64)
                        unframe(np.frombuffer(raw, np.uint8), at, size)
                        docs, counts, crcs = [], [], []
                        for a, b in zip((at + 12).tolist(), (at + 12 + size).tolist()):
                            flags = raw[a + 8]
                            ids = np.frombuffer(raw, "<u4" if flags & 2 else "<u2", offset=a + 9, count=(b - a - 9) // (4 if flags & 2 else 2))
                            docs.append(None if flags & 1 else int.from_bytes(raw[a : a + 8], "little", signed=True))
                            counts.append(len(ids))
                            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        yield sp.batch(READ, docs, first[k:to], counts, crcs)
                        k = to

    return sp.arrow_map(named, run, READ)
