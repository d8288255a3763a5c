"""Posting codecs: gaps, and variable-byte, unary and gamma codes, as Arrow UDFs over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_encode(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(v, i)))


def gap_decode(v: Column) -> Column:
    """Running sums in one pass: an aggregate of arrays in the JVM would copy or sum each list again for every number."""

    @F.pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.cumsum(np.asarray(x, dtype=np.int64)))

    return run(v)


def vb_encode(numbers: list[int]) -> bytes:
    """Seven bits a byte, high ones first; the last byte of a number has the high bit."""
    out = bytearray()
    for n in numbers:
        part = [n & 127 | 128]
        while n := n >> 7:
            part.append(n & 127)
        out += bytes(reversed(part))
    return bytes(out)


def vb_decode(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            out.append(n)
            n = 0
    return out


def unary_encode(numbers: list[int]) -> bytes:
    return _pack("".join("1" * n + "0" for n in numbers))


def unary_decode(data: bytes, count: int) -> list[int]:
    return [len(x) for x in _bits(data).split("0")[:count]]


def gamma_encode(numbers: list[int]) -> bytes:
    """Elias gamma of positive numbers: the length in unary, then the bits after the first."""
    return _pack("".join("1" * (n.bit_length() - 1) + "0" + bin(n)[3:] for n in numbers))


def gamma_decode(data: bytes, count: int) -> list[int]:
    bits, at, out = _bits(data), 0, []
    for _ in range(count):
        size = bits.index("0", at) - at
        at += size + 1
        out.append(int("1" + bits[at : at + size], 2))
        at += size
    return out


def _pack(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def _bits(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def encoded(v: Column, function=vb_encode) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: function([int(i) for i in x]))

    return run(v)


def decoded(v: Column, function=vb_decode) -> Column:
    @F.pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return run(v)
