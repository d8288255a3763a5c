"""op1 and the pipeline's quality stage leave no shuffle files and tables behind that nothing reads any more, and send little."""

from __future__ import annotations

import pickle
from pathlib import Path

import numpy as np
import pytest

from textloom.llm import counts, quality
from textloom.llm import spark as sp


def shuffle_files(spark) -> dict[str, int]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name: f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def tables(spark) -> set[str]:
    return {p.name for p in Path(sp.shared_dir(spark).removeprefix("file:"), "textloom").glob("*")}


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_done_steps_are_cleared(spark, documents, texts, monkeypatch, most):
    monkeypatch.setattr(quality, "GRAMS", most)
    docs = documents.repartition(3)
    files, made = shuffle_files(spark), tables(spark)
    out = quality.rules(docs)
    size = sum(n for f, n in shuffle_files(spark).items() if f not in files)
    assert size < sum(len(t or "") for t in texts.values()) / 10
    assert {t.split("-")[0] for t in tables(spark) - made} == ({"quality", "bands"} if most else {"quality", "lacks", "bands"})
    assert out.count() == documents.count()


def test_model_and_requests_are_sent_compressed():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 49, 200_000).astype(np.uint64))
    words = quality.Vocabulary(keys[::7], np.zeros(0), np.ones(5), np.unique(rng.integers(0, 1 << 63, 1_000).astype(np.uint64)))
    model = quality.Model(words, keys, rng.geometric(0.4, len(keys)), *(rng.random(9) for _ in range(4)), np.arange(9, dtype=np.int32))
    data = pickle.dumps(model)
    assert len(data) < 8 * len(keys)
    got = pickle.loads(data)
    for a, b in ((got, model), (got.words, model.words)):
        for name, x in vars(b).items():
            assert name == "words" or x.dtype == vars(a)[name].dtype and (x == vars(a)[name]).all()
    whose, own = rng.integers(0, 1_500, len(keys)).astype(np.int32), np.ones(len(keys), np.int32)
    sent = list(quality.asked([(keys, whose, own, own)], 20))
    assert sum(len(x) for _, *blobs in sent for x in blobs) < 8 * len(keys)
    assert sum(len(counts.unpack(counts.loose(k))) for _, k, *_ in sent) == len(keys)
