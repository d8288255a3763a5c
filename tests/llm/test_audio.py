"""op5: lossless media, digests against hashlib, features against plain loops, tensors and spans read back."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from textloom.llm import audio
from textloom.llm import spark as sp


def padded(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def check(docs):
    rows = audio.digests(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        p = padded(r.text)
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44, hashlib.sha256(audio.to_wav(p)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    alike = {}
    for r in rows:
        assert alike.setdefault(r.payload_sha256, r.feature) == r.feature


def test_documents(documents):
    check(documents)


def test_odd(odd):
    check(odd)


def test_empty_and_clashing(empty, clashing):
    assert audio.digests(empty).collect() == []
    assert audio.digests(clashing).count() == 8


def plain_log_mel(data: bytes):
    """One clip on its own, output sample by output sample and frame by frame."""
    x = np.frombuffer(data, np.uint8).astype(float) - 128
    bank = audio.phases(audio.UP, audio.DOWN)
    half = bank.shape[1] // 2
    n = len(x) * audio.UP // audio.DOWN
    frames = int(audio.frames_of(len(x)))
    y = np.zeros(frames * audio.HOP + audio.FRAME)
    for i in range(len(y)):
        place, phase = i * audio.DOWN // audio.UP, i % audio.UP
        y[i] = np.rint(sum(bank[phase][k] * x[place + k - half + 1] for k in range(2 * half) if 0 <= place + k - half + 1 < len(x)) / 4096)
    weights = audio.mel_weights(audio.RATE * audio.UP // audio.DOWN)
    out, level = [], []
    for f in range(frames):
        part = y[f * audio.HOP : f * audio.HOP + audio.FRAME]
        level.append(10 * np.log10((part**2).sum() / audio.FRAME + 1e-3))
        spectrum = np.abs(np.fft.rfft(part * audio._WINDOW, audio.FFT)) ** 2
        out.append(np.log10(np.rint(spectrum / 256) @ weights + 1))
    assert n <= len(y)
    return np.array(out), level


@pytest.mark.parametrize("n", [64, 128, 640, 3200])
def test_features_against_plain_loops(n):
    rng = np.random.default_rng(n)
    clip = rng.integers(32, 128, n, np.uint8).tobytes()
    mel, level, first = audio.log_mel([np.frombuffer(c, np.uint8) for c in (b"x" * 64, clip, b"y" * 256)])
    want, want_level = plain_log_mel(clip)
    assert mel[first[1] : first[2]] == pytest.approx(want, abs=2e-3)
    assert level[first[1] : first[2]] == pytest.approx(want_level, abs=1e-6)


def test_hysteresis():
    level = np.array([0, 34, 31, 31, 29, 31, 33, 20, 0, 40.0])
    begin, end, clip = audio.segments(level, np.array([0, 9, 10]))
    assert list(zip(begin, end, clip)) == [(1, 4, 0), (6, 7, 0), (9, 10, 1)]


def test_tensors_and_spans_read_back(spark):
    texts = {1: "a" * 50, 2: "words and words " * 3000, 3: "\n" * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = sp.written(audio.features(docs), "media")
    for r in table.toArrow().to_pylist():
        data = padded(texts[r["doc_id"]])
        assert audio.from_wav(r["media"]) == (data, audio.RATE)
        mel, level, first = audio.log_mel([np.frombuffer(data, np.uint8)])
        tensors = np.frombuffer(b"".join(r["log_mel"]), np.uint8).reshape(-1, audio.TENSOR_FRAMES, audio.MELS)
        flat = np.concatenate([t[:n] for t, n in zip(tensors, r["frames"])])
        assert (flat == np.rint(mel * 16)).all() and flat.max() < 255  # nothing is cut off
        assert all((t[n:] == 0).all() for t, n in zip(tensors, r["frames"]))
        hop = audio.HOP * audio.DOWN / audio.UP / audio.RATE
        assert r["end_s"] == pytest.approx(np.cumsum(r["frames"]) * hop)
        assert r["start_s"] == pytest.approx([0, *np.cumsum(r["frames"])[:-1] * hop])
        begin, end, _ = audio.segments(level, first)
        assert r["segment_start_s"] == pytest.approx(begin * hop) and r["segment_end_s"] == pytest.approx(end * hop)
