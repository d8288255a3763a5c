"""Approximate string search and joins over q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.similarity import edit_similarity
from textloom.functions.text import padded_qgrams


def grams(strings: DataFrame, q: int = 3) -> DataFrame:
    """id, gram, pos, n: the padded q-grams of (id, text)."""
    return strings.select("id", F.length("text").alias("n"), F.explode(padded_qgrams(F.col("text"), q)).alias("g")).select("id", "n", "g.gram", "g.pos")


def gram_weights(g: DataFrame) -> DataFrame:
    """gram, n, df, idf."""
    total = g.select("id").distinct().agg(F.count("*").alias("total"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df")).join(F.broadcast(total)).select("gram", "n", "df", F.log((F.col("total") + 1) / F.col("df")).alias("idf"))


def prefix(g: DataFrame, weights: DataFrame, q: int, tau: int) -> DataFrame:
    """The rarest q tau + 1 grams of each string: strings within edit distance tau share one of them."""
    w = Window.partitionBy("id").orderBy("df", "gram", "pos")
    return g.join(weights.select("gram", "df"), "gram").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= q * tau + 1)


def deletions(text: Column) -> Column:
    """Hashes of a text and of all that are left by deleting one character."""
    one = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1)))
    return F.array_distinct(F.transform(F.when(F.length(text) > 0, F.concat(F.array(text), one)).otherwise(F.array(text)), lambda t: F.xxhash64(t)))


def edit_join(left: DataFrame, right: DataFrame, tau: int = 2, q: int = 2) -> DataFrame:
    """Pairs of (id, text) within edit distance tau, found between distinct texts and verified there.

    Texts one edit apart are equal after deleting at most one character of each, which few other texts are, so for a tau
    of 1 they meet by hashes of these; for others by the rarest grams, with length and position filters.  Joins are
    sort-merge joins at every size: a small file of names can be a large table in the driver.
    """
    sides = [x.filter("text IS NOT NULL").select("text").distinct() for x in (left, right)]
    if tau == 1:
        a, b = (x.select(F.col("text").alias(name), F.explode(deletions(F.col("text"))).alias("h")) for x, name in zip(sides, "ab"))
        found = a.join(b.hint("merge"), "h")
    else:
        found = _near_by_grams(*sides, tau, q)
    pairs = found.withColumn("distance", F.levenshtein("a", "b", tau)).filter("distance >= 0").select("a", "b", "distance").distinct()
    full = pairs.join(left.select(F.col("id").alias("left_id"), F.col("text").alias("a")).hint("merge"), "a").join(right.select(F.col("id").alias("right_id"), F.col("text").alias("b")).hint("merge"), "b")
    return full.select("left_id", "right_id", "a", "b", "distance")


def _near_by_grams(left: DataFrame, right: DataFrame, tau: int, q: int) -> DataFrame:
    """Texts a, b that share one of their rarest grams; those too short to have a gram left after tau edits meet all of about their length."""
    gl, gr = (grams(x.select(F.col("text").alias("id"), "text"), q) for x in (left, right))
    weights = gram_weights(gl.select(F.concat(F.lit("l"), "id").alias("id"), "n", "gram", "pos").unionByName(gr.select(F.concat(F.lit("r"), "id").alias("id"), "n", "gram", "pos")))
    a = prefix(gl, weights, q, tau).select(F.col("id").alias("a"), "gram", F.col("n").alias("ln"), F.col("pos").alias("lp"))
    b = prefix(gr, weights, q, tau).select(F.col("id").alias("b"), "gram", F.col("n").alias("rn"), F.col("pos").alias("rp"))
    near = a.join(b.hint("merge"), "gram").filter((F.abs(F.col("ln") - F.col("rn")) <= tau) & (F.abs(F.col("lp") - F.col("rp")) <= tau)).select("a", "b")
    least = q * tau - q + 1  # grams of a string: length + q - 1, of which tau edits touch q tau
    short = lambda x, name: x.filter(F.length("text") <= max(least, 0) + tau).select(F.col("text").alias(name), F.length("text").alias("n"))
    few = short(left, "a").withColumn("m", F.explode(F.sequence(F.col("n") - tau, F.col("n") + tau))).drop("n").join(short(right, "b").withColumnRenamed("n", "m"), "m").select("a", "b")
    return near.unionByName(few)


def search(strings: DataFrame, queries: DataFrame, q: int = 3, prefix_size: int = 6, top_k: int = 10) -> DataFrame:
    """The strings most like each query (qid, text) by the idf of its rarest shared grams, then by edit similarity.

    Scores are of distinct texts, of which only the ``top_k`` lowest ids can be among the best; nothing that grows with
    the strings is broadcast.
    """
    texts = strings.filter("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("k"))
    g = texts.select("text", "k", F.explode(F.array_distinct(F.transform(padded_qgrams(F.col("text"), q), lambda x: x["gram"]))).alias("gram"))
    total = strings.agg(F.count("text").alias("total"))
    own = grams(queries.select(F.col("qid").alias("id"), "text"), q).select(F.col("id").alias("qid"), "gram").distinct()
    weights = g.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("k").alias("df")).join(F.broadcast(total)).select("gram", F.log((F.col("total") + 1) / F.col("df")).alias("idf"))
    w = Window.partitionBy("qid").orderBy(F.desc("idf"), "gram")
    asked = own.join(weights, "gram").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= prefix_size)
    found = g.join(asked, "gram").groupBy("qid", "text").agg(F.sum("idf").alias("weight")).join(queries.select("qid", F.col("text").alias("query")), "qid")
    scored = found.select("qid", "text", "weight", edit_similarity(F.col("text"), F.col("query")).alias("score"))
    lowest = Window.partitionBy("text").orderBy("id")
    few = strings.select("id", "text").withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= top_k).select("id", "text")
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = scored.join(few.hint("merge"), "text").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top_k)
    return ranked.select("qid", "id", F.col("r").cast("long").alias("rank"), "weight", "score")


def longest_prefix(keys: DataFrame, words: DataFrame) -> DataFrame:
    """The longest key that is a prefix of each word: equi-join on the word's prefixes."""
    cut = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left("word", n))).alias("key"))
    return cut.join(keys.select("key").distinct(), "key").groupBy("word").agg(F.max_by("key", F.length("key")).alias("longest"))
