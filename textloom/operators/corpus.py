"""Documents as tokens, vocabularies, vectors and postings.

Tables stay at the grain of (document, term); lists of positions are kept there and
never gathered by term, since the list of a frequent term would be one huge row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tf_
from textloom.operators import shards

UNKNOWN = "<unk>"


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """doc_id, sent_id, pos, term. A line break takes one position.

    only: keep these terms; applied inside the array, before it is exploded.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), tf_.tokens_with_breaks(F.col(text_col)).alias("w"))
    if only is not None:
        at = F.filter(F.transform("w", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: x["term"].isin(only))
        return words.select("doc_id", F.explode(at).alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.col("x.term").alias("term"))
    rows = words.select("doc_id", F.posexplode("w").alias("pos", "term"))
    return rows.filter(F.col("term") != tf_.BREAK)


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos (in the sentence), term."""
    return docs.select("doc_id", F.posexplode(tf_.sentences(F.col("text"))).alias("sent_id", "s")).select("doc_id", "sent_id", F.posexplode("s").alias("pos", "term"))


def doc_vectors(toks: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def postings(toks: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions (sorted); partitioned and sorted by term when written."""
    return toks.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def write_postings(posts: DataFrame, path: str, parts: int | None = None) -> None:
    """Postings as Parquet, sorted by term inside range partitions, so that a term or a range of terms reads few row groups."""
    dealt = posts.repartitionByRange(parts, "term", "doc_id") if parts else posts.repartitionByRange("term", "doc_id")
    dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def vocabulary(vectors: DataFrame) -> DataFrame:
    """term, cf, df."""
    return vectors.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def term_counts(docs: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, term, cf of a few terms (term) over all documents; counted before anything is shuffled. The terms are broadcast, so they must be those of a bounded number of documents."""
    words = docs.select(*by, F.explode(tf_.tokens_with_breaks(F.col("text"))).alias("term"))
    return words.join(F.broadcast(terms), "term", "left_semi").filter(F.col("term") != tf_.BREAK).groupBy(*by, "term").agg(F.count("*").alias("cf"))


def folded_vocabulary(vectors: DataFrame, min_count: int = 5, max_length: int = 100) -> DataFrame:
    """The vocabulary with rare and long terms folded into UNKNOWN; its df is the sum of theirs."""
    vocab = vocabulary(vectors)
    term = F.when((F.col("cf") < min_count) | (F.length("term") > max_length), F.lit(UNKNOWN)).otherwise(F.col("term"))
    return vocab.groupBy(term.alias("term")).agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def with_ids(vocab: DataFrame, *order: Column) -> DataFrame:
    """Dense ids by the order (ties by term).

    Rows are range-partitioned and numbered by partition offsets, so no single task sorts them all.
    """
    spark = vocab.sparkSession
    keys = [*order, F.col("term").asc()]
    # a stated number of partitions isn't coalesced, and both passes read the same rows: those written once, if there is a folder for them
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = vocab.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/textloom/ids-{uuid.uuid4().hex}"
        dealt.write.parquet(path)
        dealt = spark.read.schema(dealt.schema).parquet(path)
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets, "p long, base long")
    return dealt.withColumn("p", part).join(F.broadcast(table), "p").withColumn("term_id", F.col("base") + place).drop("__m", "p", "base")


def doc_lengths(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def collection_stats(vectors: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, avg_dl, min_dl, max_dl."""
    return doc_lengths(vectors).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avg_dl"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))


def encode(toks: DataFrame, vocab: DataFrame, known_only: bool = False) -> DataFrame:
    """Tokens with term_id; unknown terms get UNKNOWN's id, or go."""
    ids = vocab.select("term", "term_id")
    if known_only:
        return toks.join(ids, "term").select("doc_id", "pos", "term_id")
    unknown = ids.filter(F.col("term") == UNKNOWN).select(F.col("term_id").alias("unk"))
    return toks.join(ids, "term", "left").join(F.broadcast(unknown)).select("doc_id", "pos", F.coalesce("term_id", "unk").alias("term_id"))


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    return encoded.join(vocab.select("term_id", "term"), "term_id").select("doc_id", "pos", "term")


def cooccurrence(docs: DataFrame, window: int, least: int = 1, inclusive: bool = True, symmetric: bool = False) -> DataFrame:
    """left, right, weight (the sum of 1 / distance) and n of pairs of terms of a text (doc_id, text) that occur ``least`` times or more.

    The second term is at most ``window`` positions after the first; a line break takes one.  Pairs are counted by shards,
    by their distance; symmetric ones are one pair until they are summed.
    """
    reach = window if inclusive else window - 1

    def done(texts: pa.Array, words: int, sums: list[np.ndarray], shard: int) -> pa.RecordBatch:
        n, weight = sum(sums), sum(c / (k + 1) for k, c in enumerate(sums))
        few = n >= (-(-least // 2) if symmetric else least)  # a term beside itself counts twice where pairs are symmetric
        pairs = pc.split_pattern(shards.whole(texts, few), " ")
        left, right = (pc.list_element(pairs, k).combine_chunks() if isinstance(pairs, pa.ChunkedArray) else pc.list_element(pairs, k) for k in (0, 1))
        n, weight = n[few], weight[few]
        if symmetric:
            itself = pc.equal(left, right).to_numpy(zero_copy_only=False)
            twice = 1 + itself
            back = np.flatnonzero(~itself)
            left, right = pa.concat_arrays([left, right.take(pa.array(back))]), pa.concat_arrays([right, left.take(pa.array(back))])
            n, weight = (np.concatenate([x * twice, x[back]]) for x in (n, weight))
        out = pa.RecordBatch.from_arrays([left, right, pa.array(weight), pa.array(n)], names=["left", "right", "weight", "n"])
        return out.filter(pa.array(n >= least))

    return shards.summed(docs, lambda chunk, n: shards.pair_blocks(chunk, n, reach, not symmetric), reach, done, "left string, right string, weight double, n long")


def collocations(toks: DataFrame, x: str, y: str, window: int, ordered: bool = True) -> DataFrame:
    """Each x with the first following y within ``window`` positions; unordered: also each y with the first following x."""
    def following(a: str, b: str) -> DataFrame:
        w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
        hit = F.first(F.when(F.col("term") == b, F.col("pos")), ignorenulls=True).over(w)
        return toks.filter(F.col("term").isin(a, b)).withColumn("end", hit).filter((F.col("term") == a) & (F.col("end") - F.col("pos") <= window)).select("doc_id", F.col("pos").alias("start"), "end")

    out = following(x, y)
    return out if ordered or x == y else out.unionByName(following(y, x)).distinct()


def phrase(toks: DataFrame, words: list[str]) -> DataFrame:
    """Places of an exact phrase: doc_id, start, end."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    found = F.col("term") == words[0]
    for k, word in enumerate(words[1:], 1):
        found &= (F.lead("term", k).over(w) == word) & (F.lead("pos", k).over(w) == F.col("pos") + k)
    near = toks.filter(F.col("term").isin(list(set(words))))
    return near.withColumn("hit", found).filter("hit").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + len(words) - 1).alias("end"))


def passages(toks: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Tokens with the passages that cover them: tumbling, or sliding with a step."""
    if step is None or step == size:
        return toks.withColumn("passage", F.floor(F.col("pos") / size).cast("long"))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    return toks.withColumn("passage", F.explode(F.sequence(first.cast("long"), F.floor(F.col("pos") / step).cast("long"))))


def context(toks: DataFrame, k: int) -> DataFrame:
    """Each token with the terms up to k rows before and after it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    around = lambda a, b: F.collect_list("term").over(w.rowsBetween(a, b))
    return toks.select("doc_id", "pos", "term", around(-k, -1).alias("before"), around(1, k).alias("after"))
