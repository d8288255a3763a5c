"""Quality classifier from weak labels: expectation-maximisation and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every document.  Spark
counts the patterns of votes (at most 3^13 of them, whatever the corpus), and
expectation-maximisation over these counts estimates each labeller's votes given the
class, and the share of good documents.  The posterior of a document's pattern is
then the soft label with which tasks train a linear scorer over hashed words and word
endings, by AdaGrad steps over their part of all documents; weights are averaged by
visits.  The scorer's probability decides.

Defined cases: a null or empty text gets its labellers' votes as a text without
words; repeated rows get equal results each; an empty table gives an empty one;
other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from . import spark as sp
from . import text as tx

SLOTS = 1 << 16
LABELLERS = ("symbols", "repeats", "length", "word_length", "repeated_lines", "capitals", "line_ends", "separators", "letters", "lone_characters", "doubled", "shouts", "word_ends")
_IS = {name: np.isin(np.arange(256), list(chars.encode())) for name, chars in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "stop": ".!?:;\"')", "bar": "|\t", "shout": "!"}.items()}

_LETTER = _IS["upper"] | _IS["lower"] | (np.arange(256) >= 0xC0)  # a byte for each letter beyond ASCII


def votes(chunk: tx.Chunk) -> np.ndarray:
    """Votes of the labellers (rows: texts): 1 good, 0 bad, 2 abstain."""
    n_words, chars, symbols, dup_lines, repeats = quality.base(chunk)
    buf, off = chunk.buf, chunk.off
    per = lambda name: tx.per_doc(_IS[name][buf], off)
    line, line_end, first = tx.spans(buf != 0x0A, off)
    stopped = tx.per_doc(_IS["stop"][buf[line_end - 1]], first) if len(line) else np.zeros(chunk.n)
    lines = np.diff(first)
    some = np.maximum(n_words, 1)
    w = tx.words(chunk)
    alone = tx.per_doc(w.end - w.start == 1, w.first)
    ends = tx.per_doc(quality._SYMBOL[buf[w.end - 1]], w.first) if len(w.end) else np.zeros(chunk.n)
    h = tx.hashes(buf, w.start, w.end)
    twice = np.zeros(len(h), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[w.first[:-1][w.count > 0]] = False
    doubled = tx.per_doc(twice, w.first)
    letters = tx.per_doc(_LETTER[buf], off)
    upper, lower = per("upper"), per("lower")

    def vote(value, bad, good):
        return np.where(bad(value), 0, np.where(good(value), 1, 2))

    out = [
        vote(symbols / np.maximum(chars, 1), lambda x: x > 0.08, lambda x: x < 0.01),
        vote(repeats / some, lambda x: x > 0.3, lambda x: x < 0.1),
        vote(n_words, lambda x: x < 10, lambda x: x >= 60),
        vote(chars / some, lambda x: (x < 2) | (x > 15), lambda x: (x > 3) & (x < 10)),
        vote(dup_lines / np.maximum(lines, 1), lambda x: x > 0.3, lambda x: x == 0),
        vote(upper / np.maximum(upper + lower, 1), lambda x: x > 0.5, lambda x: x < 0.2),
        vote(stopped / np.maximum(lines, 1), lambda x: x < 0.2, lambda x: x > 0.6),
        vote(per("bar") / some, lambda x: x > 0.1, lambda x: x < 0.01),
        vote(letters / np.maximum(chars, 1), lambda x: x < 0.85, lambda x: x > 0.93),
        vote(alone / some, lambda x: x > 0.15, lambda x: x < 0.08),
        vote(doubled / some, lambda x: x > 0.1, lambda x: x < 0.03),
        vote(per("shout") / some, lambda x: x > 0.25, lambda x: x < 0.1),
        vote(ends / some, lambda x: x > 0.1, lambda x: x < 0.02),
    ]
    return np.stack(out, 1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


@dataclass
class Labels:
    """share: of good documents; tables: P(vote | class) by labeller, class (bad, good) and vote."""

    share: float
    tables: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        v = np.asarray(v)
        log = np.log([1 - self.share, self.share])[None] + sum(np.log(self.tables[j][:, v[:, j]]).T for j in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, n: int = len(LABELLERS), rounds: int = 100) -> Labels:
    """Expectation-maximisation over counted patterns, from the assumption that votes are right more often than not."""
    v = patterns[:, None] // 3 ** np.arange(n) % 3
    prior = np.array([[3.0, 1.0, 1.0], [1.0, 3.0, 1.0]])
    tables = np.repeat((prior / prior.sum(1, keepdims=True))[None], n, 0)
    model, total = Labels(0.7, tables), counts.sum()
    weight = prior * max(1.0, 0.001 * total)  # keeps each class's meaning and every probability above zero
    for _ in range(rounds):
        good = model.posterior(v)
        part = np.stack([1 - good, good]) * counts
        tables = np.stack([np.stack([np.bincount(v[:, j], part[c], 3) for c in (0, 1)]) + weight for j in range(n)])
        tables /= tables.sum(2, keepdims=True)
        share = float(np.clip((part[1].sum() + 1) / (total + 2), 0.01, 0.99))
        done = np.abs(tables - model.tables).max() < 1e-7
        model = Labels(share, tables)
        if done:
            break
    return model


def hashed(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features, their documents, and each document's scale."""
    chunk = chunk.lower()
    w = tx.words(chunk)
    whole = tx.hashes(chunk.buf, w.start, w.end)
    tail = tx.hashes(chunk.buf, np.maximum(w.start, w.end - 2), w.end) ^ np.uint64(0xABCD)
    slot = np.concatenate([whole, tx.mix64(tail)]) >> np.uint64(48)
    doc = np.concatenate([w.doc, w.doc])
    return slot.astype(np.int64), doc, 1 / np.sqrt(np.maximum(2 * w.count, 1))


def logits(weights: np.ndarray, bias: float, slot: np.ndarray, doc: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights[slot], len(scale)) * scale + bias


def vote_counts(docs: DataFrame) -> DataFrame:
    """How many documents have each pattern of votes (at most 3^13 rows)."""

    def run(batches):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for _, chunk in tx.chunks(batches, "text"):
            total += np.bincount(pattern(votes(chunk)), minlength=len(total))
        at = np.flatnonzero(total)
        yield sp.batch("pattern int, n long", at, total[at])

    return sp.arrow_map(docs.select("text"), run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: Labels, rate: float = 0.5, passes: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, averaged over tasks by visits."""

    def run(batches):
        w, square, visits = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-2), np.zeros(SLOTS + 1)
        for _, chunk in tx.chunks(batches, "text", 1 << 18):
            target = labels.posterior(votes(chunk))
            slot, doc, scale = hashed(chunk)
            for _ in range(passes):
                p = 1 / (1 + np.exp(-np.clip(logits(w, w[SLOTS], slot, doc, scale), -30, 30)))
                error = (p - target) / chunk.n
                g = np.append(np.bincount(slot, (error * scale)[doc], SLOTS), error.sum())
                square += g * g
                w -= rate * g / np.sqrt(square)
            visits[:SLOTS] += np.bincount(slot, minlength=SLOTS)
            visits[SLOTS] += chunk.n
        at = np.flatnonzero(visits)
        yield sp.batch("slot int, total double, visits double", at, (w * visits)[at], visits[at])

    rows = sp.arrow_map(docs.select("text"), run, "slot int, total double, visits double").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("visits").alias("visits")).toPandas()  # a row a slot
    out = np.zeros(SLOTS + 1)
    out[rows["slot"]] = rows["total"] / rows["visits"]
    return out[:SLOTS], float(out[SLOTS])


SCHEMA = "doc_id long, votes string, n_votes long, posterior double, score double, kept boolean"


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: votes (1 good, 0 bad, - none), the posterior of its votes, the scorer's probability, and kept."""
    named = sp.id_and_text(docs, id_col, text_col)
    counted = vote_counts(named).orderBy("pattern").toPandas()
    labels = estimate(counted["pattern"].to_numpy(), counted["n"].to_numpy().astype(float)) if len(counted) else Labels(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    held = named.sparkSession.sparkContext.broadcast((labels, *fit(named, labels)))  # a fixed size

    def run(batches):
        labels, weights, bias = held.value
        names = np.array(["0", "1", "-"])
        for rows, chunk in tx.chunks(batches, "text"):
            v = votes(chunk)
            score = 1 / (1 + np.exp(-np.clip(logits(weights, bias, *hashed(chunk)), -30, 30)))
            yield sp.batch(SCHEMA, rows.column(0), ["".join(r) for r in names[v].tolist()], (v != 2).sum(1), labels.posterior(v), score, score >= threshold)

    return sp.arrow_map(named, run, SCHEMA)
