"""Maps, counters and matrices as tables: merges, transposes, linear keys, language models of single documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_vocabularies(vocabularies: list[DataFrame]) -> DataFrame:
    """term, cf, df and in how many of the vocabularies (term, cf, df) it is."""
    out = vocabularies[0].select("term", "cf", "df")
    for v in vocabularies[1:]:
        out = out.unionByName(v.select("term", "cf", "df"))
    return out.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.count("*").alias("n_vocabularies"))


def merged_postings(runs: list[DataFrame]) -> DataFrame:
    """Runs of (doc_id, term, tf) as one; a document in several runs has the sum."""
    out = runs[0].select("doc_id", "term", "tf")
    for r in runs[1:]:
        out = out.unionByName(r.select("doc_id", "term", "tf"))
    return out.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def linear_key(row: Column, column: Column, columns: int) -> Column:
    """One number for a cell of a matrix with so many columns."""
    return row.cast("long") * columns + column.cast("long")


def from_linear_key(key: Column, columns: int) -> tuple[Column, Column]:
    return F.floor(key / F.lit(columns)).cast("long"), F.pmod(key, F.lit(columns)).cast("long")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetric(cells: DataFrame) -> DataFrame:
    """The matrix plus its transpose, over row and column names together."""
    return cells.select("i", "j", "v").unionByName(transposed(cells)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_matrix(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Sums of outer products of each group's vectors: rows (*by, i, j, v); cells are added up before they are shuffled."""
    left = vectors.select(*by, "vec", F.posexplode("vec").alias("i", "a"))
    return left.select(*by, "i", "a", F.posexplode("vec").alias("j", "b")).groupBy(*by, "i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("v"))


def parsimonious(vectors: DataFrame, vocab: DataFrame, mix: float = 0.1, rounds: int = 3) -> DataFrame:
    """doc_id, term, p: document models that leave to the corpus what it explains, by so many rounds of expectation-maximisation.

    ``mix`` is the document's share of the mixture. Rounds are windows by document over rows that stay where they are.
    """
    total = vocab.agg(F.sum("cf").alias("n"))
    rows = vectors.join(vocab.select("term", "cf"), "term").join(F.broadcast(total)).select("doc_id", "term", "tf", (F.col("cf") / F.col("n")).alias("c"))
    of = Window.partitionBy("doc_id")
    rows = rows.withColumn("p", F.col("tf") / F.sum("tf").over(of))
    for _ in range(rounds):
        e = F.col("tf") * mix * F.col("p") / (mix * F.col("p") + (1 - mix) * F.col("c"))
        rows = rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(of)).drop("e")
    return rows.select("doc_id", "term", "p")


def between_frequencies(vocab: DataFrame, n_docs: DataFrame, least: float, most: float) -> DataFrame:
    """Terms in at least and at most such shares of the documents (n_docs: one row, n)."""
    return vocab.join(F.broadcast(n_docs)).filter((F.col("df") >= least * F.col("n")) & (F.col("df") <= most * F.col("n"))).select("term", "cf", "df")
