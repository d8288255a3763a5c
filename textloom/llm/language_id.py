"""Language identification by the nearest of several centroids per language.

A text is the L2-normalised TF-IDF vector of its hashed byte 2-, 3- and 4-grams
(letters without case, runs of anything else as one border).  Document frequencies
are counted over all labelled training documents.  Centroids are fitted by
spherical k-means on a bounded sample of each language, by hash of id and text: an
expected ``sample`` distinct documents of each language, and twice as many at most.
All languages are learned; the model has 128 kB for each.  A
text gets the language of the centroid with the highest cosine; it is rejected when
its distance is above a bound that is fitted, by language, on the same sample.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; without any learned language all are ``und``; repeated rows get equal
results each; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spark as sp
from . import text as tx

DIMS = 1 << 13
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 256)
_LETTER = r"\p{L}"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and each text's first one."""
    chunk = tx.as_chunk(pc.utf8_lower(texts))
    buf = _FOLD[chunk.buf]
    keep = np.ones(len(buf), bool)  # one border for a run
    keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)
    full = np.diff(chunk.off) > 0
    keep[chunk.off[:-1][full]] = True
    off = np.concatenate([[0], np.cumsum(keep)])[chunk.off]
    x = np.concatenate([buf[keep], np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(x) - 3
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    code, parts = x[:n].copy(), []
    for size in (2, 3, 4):
        code = code << np.uint32(8) | x[size - 1 : size - 1 + n]
        mixed = (code ^ np.uint32(size * 0x1F123BB5)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        parts.append(np.where(left >= size, mixed >> np.uint32(32 - 13), DIMS).astype(np.int32))
    return np.stack(parts, 1).reshape(-1), off * 3


def frequencies(texts: pa.Array) -> np.ndarray:
    """Damped term frequencies (rows: texts, columns: buckets)."""
    bucket, first = grams(texts)
    out = np.empty((len(first) - 1, DIMS), np.float32)
    for i in range(len(out)):
        out[i] = np.bincount(bucket[first[i] : first[i + 1]], minlength=DIMS + 1)[:DIMS]
    return np.sqrt(out, out)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    out = frequencies(texts)
    out *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-12)[:, None]
    return out


def few(texts: pa.Array, most: int = 64):
    """Slices of rows whose matrices stay small."""
    for k in range(0, len(texts), most):
        yield k, texts.slice(k, most)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far apart starting points, without chance."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    centre = x[picked].copy()
    for _ in range(rounds):
        at = np.argmax(x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (at == c).any():
                m = x[at == c].sum(0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    return centre


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: rows: centroids, and the language of each
    centroids: np.ndarray
    owner: np.ndarray
    #: least cosine by language, for a text of many n-grams
    floor: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine) and rejection of each text."""
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        texts = pc.fill_null(texts, "")
        lettered = np.asarray(pc.match_substring_regex(texts, _LETTER))
        names = np.full(len(texts), UNKNOWN, object)
        if not self.languages:
            return names.tolist(), scores, rejected
        for k, part in few(texts):
            cosine = vectors(part, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            at = k + np.flatnonzero(lettered[k : k + len(part)])
            who = self.owner[best[at - k]]
            scores[at] = np.clip(cosine[at - k, best[at - k]], 0, 1)
            names[at] = np.array(self.languages, object)[who]
            size = np.asarray(pc.binary_length(part))[at - k]
            # short texts have few n-grams and lie farther from any centroid
            rejected[at] = scores[at] < self.floor[who] * np.sqrt(size / (size + 400.0))
        return names.tolist(), scores, rejected


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(labelled: DataFrame, centroids: int = 4, sample: int = 1500, margin: float = 0.6) -> Model:
    """The model of a table (doc_id, text, lang) of labelled documents.

    sample: expected number of documents of a language that centroids are fitted on; twice as many are the most.
    """
    spark = labelled.sparkSession
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")

    def tally(batches):
        df, langs, n = np.zeros(DIMS, np.int64), {}, 0
        for rows, _ in tx.chunks(batches, "text"):
            for _, part in few(rows.column(1)):
                df += (frequencies(part) > 0).sum(0)
            n += rows.num_rows
            for x in pc.value_counts(rows.column(2)).to_pylist():
                langs[x["values"]] = langs.get(x["values"], 0) + x["counts"]
        at = np.flatnonzero(df)
        yield sp.batch("bucket int, lang string, n long", [*at.tolist(), *[None] * (len(langs) + 1)], [*[None] * len(at), *langs, None], [*df[at].tolist(), *langs.values(), n])

    totals = sp.written(sp.arrow_map(labelled, tally, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")), "language-counts")
    df = np.zeros(DIMS)
    counted = totals.filter("bucket IS NOT NULL").toPandas()  # at most DIMS rows
    df[counted["bucket"]] = counted["n"]
    n = totals.filter("bucket IS NULL AND lang IS NULL").agg(F.sum("n")).first()[0] or 0
    langs = [(r.lang, r.n) for r in totals.filter("lang IS NOT NULL").orderBy("lang").collect()]  # a row a language
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    if not langs:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    # a share of each language by hash; its expected size is the bound
    share = spark.createDataFrame([(name, min(1.0, sample / m)) for name, m in langs], "lang string, share double")
    place = (F.xxhash64("doc_id", "text", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    chosen = labelled.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("lang", "doc_id", "text").dropDuplicates()

    def fit(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order).slice(0, 2 * sample)
        texts = table["text"].combine_chunks()
        x = np.concatenate([vectors(part, idf) for _, part in few(texts)])
        centre = k_means(x, centroids)
        close = (x @ centre.T).max(1)
        size = np.asarray(pc.binary_length(texts)) + 1.0
        usual = float(np.median(close / np.sqrt(size / (size + 400.0))))
        return pa.table({"lang": [table["lang"][0].as_py()] * len(centre), "centroid": [c.tobytes() for c in centre], "usual": [usual] * len(centre)})

    found = chosen.groupBy("lang").applyInArrow(fit, "lang string, centroid binary, usual double").collect()  # a few vectors a language
    found = sorted(found, key=lambda r: (r.lang, r.centroid))
    names = sorted({r.lang for r in found})
    owner = np.array([names.index(r.lang) for r in found])
    usual = {r.lang: r.usual for r in found}
    return Model(names, idf, np.array([np.frombuffer(r.centroid, np.float32) for r in found]), owner, np.array([margin * usual[x] for x in names]))


def identify(docs: DataFrame, model: Model, rest: list[str], text: str = "text") -> DataFrame:
    """Columns ``rest`` with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors a language
    schema = sp.rows_schema(docs, rest, "lang_pred string, score double, rejected boolean")
    arrow = sp.arrow_schema(schema)

    def run(batches):
        for rows, _ in tx.chunks(batches, text):
            yield sp.rows_batch(arrow, rows, rest, *held.value.predict(rows.column(rows.schema.get_field_index(text)).cast(pa.string())))

    return sp.arrow_map(docs.select(*dict.fromkeys([text, *rest])), run, schema)


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))


def predict_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", is_held_out: Callable[[Column], Column] = held_out, **options) -> DataFrame:
    """Learns from the documents that aren't held out, and predicts the language of all."""
    named = _named(docs, id_col, text_col, lang_col)
    out = is_held_out(F.col("doc_id"))
    model = train(named.filter(~out), **options)
    return identify(named.withColumn("held_out", out), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents whose language is known, with all their columns as they are."""
    model = train(_named(docs, id_col, text_col, lang_col), **options)
    whole, own = sp.by_place(docs)
    return sp.under_old_names(identify(whole, model, list(own.values()), own[text_col]).filter(~F.col("rejected")), own)
