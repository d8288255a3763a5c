"""Audio features: polyphase resampling, log-mel filterbanks and energy segments.

Samples of many clips lie in one array with silence between them, each clip on a
frame border, so that resampling, framing, Fourier transforms and filterbanks are
single array operations.  Sums that depend on the order of additions are kept exact:
filters and mel weights are integers, and spectra are rounded to integers before
they are weighted.  A clip's features are thus the same whatever stands beside it.

Resampling from ``rate`` to ``rate * up / down`` filters with one phase of a
windowed sinc for each output place.  Frames of ``FRAME`` samples overlap by
``FRAME - HOP``.  Segments open where a frame's level rises above the upper
threshold and close where it falls below the lower one (hysteresis); they carry time
spans in seconds.  Log-mel features (of a sixteenth, in bytes) are stored as fixed-shape
Arrow tensors of ``TENSOR_FRAMES`` x ``MELS``, with the span of each.

``features`` makes a table of media files, tensors and segments, one row a document;
the query writes it to the shared folder and derives its digests from what it reads back.

Defined cases: a null or empty text is 64 bytes of zero; a text whose length is a
multiple of 64 isn't padded unless it is empty; repeated rows get equal values; an
empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spark as sp
from . import text as tx

RATE, UP, DOWN = 16_000, 2, 3
FRAME, HOP, FFT, MELS = 200, 80, 256, 40  # at the resampled rate: 18.75 and 7.5 ms
TENSOR_FRAMES = 100
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"
TENSOR = pa.fixed_shape_tensor(pa.uint8(), (TENSOR_FRAMES, MELS), dim_names=("frame", "mel"))
FEATURES = "doc_id long, n_bytes long, media binary, start_s array<double>, end_s array<double>, frames array<int>, log_mel array<binary>, segment_start_s array<double>, segment_end_s array<double>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono file."""
    riff, _, wave, fmt, size, kind, channels, rate, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, size, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not an 8-bit mono PCM file")
    return media[HEADER.size : HEADER.size + n], rate


@lru_cache(8)
def phases(up: int, down: int, reach: int = 8) -> np.ndarray:
    """Integer filter of each output phase (rows), over ``2 * reach * max(1, down / up)`` input samples."""
    wide = max(1.0, down / up)
    half = int(np.ceil(reach * wide))
    taps = np.arange(-half + 1, half + 1)
    out = []
    for phase in range(up):
        t = (taps - (phase * down / up) % 1) / wide
        w = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / reach, -1, 1)))
        out.append(np.rint(w / w.sum() * 4096))
    return np.array(out)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling of an array of integers; sums are exact. Its scale is 4096 times that of the input."""
    bank = phases(up, down)
    half = bank.shape[1] // 2
    padded = np.concatenate([np.zeros(half, np.float32), x.astype(np.float32), np.zeros(half + down, np.float32)])
    n = len(x) * up // down
    out = np.zeros(n, np.float32)
    for phase in range(up):
        m = len(range(phase, n, up))
        at = phase * down // up + 1  # of the phase's outputs each is `down` inputs further
        total = np.zeros(m, np.float32)
        for k, weight in enumerate(bank[phase].astype(np.float32)):
            if weight and m:
                total += weight * padded[at + k : at + k + down * m : down][:m]
        out[phase::up] = total
    return out


@lru_cache(4)
def mel_weights(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters with integer weights (of 1024)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.rint(np.clip(np.minimum(rise, fall), 0, None) * 1024).T.copy()


_WINDOW = np.rint((0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(FRAME) + 0.5) / FRAME)) * 256).astype(np.float32)


def frames_of(n: int | np.ndarray) -> int | np.ndarray:
    """How many frames a clip of n source samples has."""
    return np.maximum(1, -(-(n * UP // DOWN) // HOP))


def log_mel(clips: list[np.ndarray], rate: int = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-mel features (rows: frames) and levels in dB of all frames, and each clip's first frame."""
    unit = HOP * DOWN // UP
    size = np.array([len(c) for c in clips], np.int64)
    count = frames_of(size)
    room = (-(-FRAME // HOP) + 1) * unit  # silence between clips: more than a frame and a filter
    slot = -(-size // unit) * unit + room
    at = room + np.cumsum(slot) - slot
    x = np.zeros(int(at[-1] + slot[-1]) if len(at) else 0, np.float32)
    x[tx.expand(at, size)] = np.concatenate(clips).astype(np.float32) - 128
    y = resample(x)
    y = np.rint(y / 4096)
    first = at // unit
    frame = tx.expand(first, count)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([y, np.zeros(FRAME, np.float32)]), FRAME)[::HOP]
    weights = mel_weights(rate * UP // DOWN)
    mel = np.empty((len(frame), MELS), np.float32)
    level = np.empty(len(frame))
    for k in range(0, len(frame), 4096):
        part = view[frame[k : k + 4096]]
        level[k : k + 4096] = (part.astype(np.int32) ** 2).sum(1)
        spectrum = np.fft.rfft((part * _WINDOW).astype(np.float64), FFT, axis=1)
        power = np.rint((spectrum.real**2 + spectrum.imag**2) * 2.0**-8)
        mel[k : k + 4096] = np.log10(power @ weights + 1)
    return mel, 10 * np.log10(level / FRAME + 1e-3), np.concatenate([[0], np.cumsum(count)])


def segments(level: np.ndarray, first: np.ndarray, rise: float = 33.0, fall: float = 30.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hysteresis over the levels: first and last frame of each segment, and its clip."""
    n = len(level)
    state = np.where(level >= rise, 1, np.where(level < fall, 0, -1))
    start = np.zeros(n, bool)
    start[first[:-1]] = True
    state[start & (state == -1)] = 0  # a clip begins outside
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(n), 0))
    on = state[known] == 1
    begin, end, seg_first = tx.spans(on, first)
    return begin, end, np.repeat(np.arange(len(first) - 1), np.diff(seg_first))


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its media file, tensors of audio features with time spans, and segments.

    ``log_mel`` holds the storage of fixed-shape tensors, padded with zeros; :func:`as_tensors` wraps it.
    """

    def run(batches):
        hop = HOP * DOWN / UP / RATE
        for rows, chunk in tx.chunks(batches, "text", 1 << 18):
            media = [to_wav(payload(chunk.doc(i))) for i in range(chunk.n)]
            mel, level, first = log_mel([np.frombuffer(from_wav(m)[0], np.uint8) for m in media])
            coded = np.rint(mel * 16).clip(0, 255).astype(np.uint8)
            count = np.diff(first)
            tensors = -(-count // TENSOR_FRAMES)
            off = np.concatenate([[0], np.cumsum(tensors)])
            doc = np.repeat(np.arange(chunk.n), tensors)
            nth = np.arange(off[-1]) - off[doc]
            frames = np.minimum(count[doc] - nth * TENSOR_FRAMES, TENSOR_FRAMES)
            whole = np.zeros((int(off[-1]) * TENSOR_FRAMES, MELS), np.uint8)
            whole[tx.expand(off[:-1] * TENSOR_FRAMES, count)] = coded
            size = TENSOR_FRAMES * MELS
            stored = pa.Array.from_buffers(pa.binary(), int(off[-1]), [None, pa.py_buffer((np.arange(off[-1] + 1) * size).astype(np.int32)), pa.py_buffer(whole)])
            begin, end, clip = segments(level, first)
            parts = pa.array(np.searchsorted(clip, np.arange(chunk.n + 1)), pa.int32())
            of = lambda off, x: pa.ListArray.from_arrays(off, x if isinstance(x, pa.Array) else pa.array(x))
            off = pa.array(off, pa.int32())
            yield sp.batch(
                FEATURES, rows.column(0), np.diff(chunk.off), media, of(off, nth * TENSOR_FRAMES * hop), of(off, (nth * TENSOR_FRAMES + frames) * hop), of(off, frames.astype(np.int32)), of(off, stored),
                of(parts, (begin - first[clip]) * hop), of(parts, (end - first[clip]) * hop),
            )

    return sp.arrow_map(sp.id_and_text(docs, id_col, text_col), run, FEATURES)


def as_tensors(log_mel: pa.Array) -> pa.Array:
    """The stored tensors of one or more documents as an array of fixed-shape tensors."""
    flat = np.frombuffer(b"".join(x.as_py() for x in log_mel), np.uint8)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), TENSOR_FRAMES * MELS))


def digests_of(table: DataFrame) -> DataFrame:
    """Per row of a table of :func:`features`: digests of its media file, of the samples in it, and of its tensors."""

    def run(batches):
        for batch in batches:
            media, frames, n_seg = (batch.column(k) for k in (2, 5, 7))
            out = []
            for i in range(batch.num_rows):
                file = media[i].as_py()
                back, _ = from_wav(file)
                tensors = as_tensors(batch.column(6)[i].values).to_numpy_ndarray()
                used = np.concatenate([t[:n] for t, n in zip(tensors, frames[i].values.to_pylist())])
                segments_of = len(n_seg[i].values)
                mean = used.sum(0, dtype=np.int64) // len(used)
                feature = f"{hashlib.blake2b(used.tobytes(), digest_size=8).hexdigest()}:{segments_of}:{mean.astype(np.uint8).tobytes().hex()}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(used), segments_of))
            if out:
                yield sp.batch(DIGESTS, batch.column(0), batch.column(1), *(list(c) for c in zip(*out)))

    return sp.arrow_map(table, run, DIGESTS)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes media files and tensors to the shared folder and gives the digests of what is read back."""
    return digests_of(sp.written(features(docs, id_col, text_col), "media", "zstd"))
