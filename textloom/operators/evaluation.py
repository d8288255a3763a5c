"""Measures of ranked results: a run (qid, doc_id, score) against judgements (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ranks and gains: qid, doc_id, rank, rel (0 where unjudged), judged."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = run.select("qid", "doc_id", F.row_number().over(w).alias("rank"))
    marks = qrels.select("qid", "doc_id", "rel", F.lit(True).alias("judged"))
    return ranked.join(marks, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("judged", F.coalesce("judged", F.lit(False)))


def evaluate(run: DataFrame, qrels: DataFrame, n: int = 10, p: float = 0.8, cut: int = 1000) -> DataFrame:
    """Per query: retrieved, relevant, rel_ret, P, R, F1, AP, nDCG, RR, RBP and bpref.

    P divides by n even where fewer are retrieved; the ideal of nDCG are the retrieved gains in order; bpref divides
    by the number of judged documents that aren't relevant. A query of the run without a relevant document has R and AP
    0; a judged query that retrieves nothing has a row of zeros.
    """
    j = judged(run, qrels).filter(F.col("rank") <= cut)
    totals = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("relevant"), F.count_if(F.col("rel") <= 0).alias("nonrelevant"))
    q = Window.partitionBy("qid")
    so_far = q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("int")
    miss = (F.col("judged") & (F.col("rel") <= 0)).cast("int")
    rows = j.select("*", F.sum(hit).over(so_far).alias("hits"), F.sum(miss).over(so_far).alias("misses"), F.row_number().over(q.orderBy(F.desc("rel"), "rank")).alias("best"))
    rows = rows.join(totals, "qid")
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    inside = F.col("rank") <= n
    out = rows.groupBy("qid").agg(
        F.count("*").alias("retrieved"),
        F.first("relevant").alias("relevant"),
        F.sum(hit).alias("rel_ret"),
        (F.sum(F.when(inside, hit).otherwise(0)) / n).alias("p_n"),
        (F.sum(F.when(inside, hit).otherwise(0)) / F.greatest(F.first("relevant"), F.lit(1))).alias("r_n"),
        (F.sum(hit * F.col("hits") / F.col("rank")) / F.greatest(F.first("relevant"), F.lit(1))).alias("ap"),
        F.sum(F.when(inside, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= n, gain / F.log2(F.col("best") + 1)).otherwise(0.0)).alias("ideal"),
        F.coalesce(1.0 / F.min(F.when(hit == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        ((1 - p) * F.sum(hit * F.pow(F.lit(p), F.col("rank") - 1))).alias("rbp"),
        F.sum(F.when(hit == 1, 1 - F.least(F.col("misses"), F.col("nonrelevant")) / F.greatest(F.col("nonrelevant"), F.lit(1))).otherwise(0.0)).alias("pref"),
    )
    f1 = F.when(F.col("p_n") + F.col("r_n") > 0, 2 * F.col("p_n") * F.col("r_n") / (F.col("p_n") + F.col("r_n"))).otherwise(0.0)
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    done = out.select("qid", "retrieved", "relevant", "rel_ret", "p_n", "r_n", f1.alias("f1"), "ap", ndcg.alias("ndcg"), "rr", "rbp", (F.col("pref") / F.greatest(F.col("relevant"), F.lit(1))).alias("bpref"))
    nothing = totals.join(done.select("qid"), "qid", "left_anti").select("qid", "relevant")
    zeros = [F.col("qid") if c == "qid" else F.col(c) if c == "relevant" else F.lit(0).cast(kind).alias(c) for c, kind in done.dtypes]
    return done.unionByName(nothing.select(*zeros))


def summary(per_query: DataFrame) -> DataFrame:
    """Sums and means over queries."""
    means = [F.avg(m).alias(f"mean_{m}") for m in ("p_n", "r_n", "f1", "ap", "ndcg", "rr", "rbp", "bpref")]
    return per_query.agg(F.count("*").alias("queries"), F.sum("retrieved").alias("retrieved"), F.sum("relevant").alias("relevant"), F.sum("rel_ret").alias("rel_ret"), *means)


def compare(base: DataFrame, other: DataFrame, metric: str = "ap", alpha: float = 1.0) -> DataFrame:
    """One row: improvement, robustness, risk, reward, trade-off and the paired t statistic."""
    d = base.select("qid", F.col(metric).alias("a")).join(other.select("qid", F.col(metric).alias("b")), "qid").withColumn("d", F.col("b") - F.col("a"))
    risk, reward = F.avg(F.greatest(F.lit(0.0), -F.col("d"))), F.avg(F.greatest(F.lit(0.0), F.col("d")))
    return d.agg(
        F.count("*").alias("queries"), F.try_divide(F.avg("b") - F.avg("a"), F.avg("a")).alias("improvement"), F.try_divide(F.sum(F.signum("d")), F.count("*")).alias("robustness"),
        risk.alias("risk"), reward.alias("reward"), (reward - (1 + alpha) * risk).alias("tradeoff"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("t"),
    )


def t_probability(t: float, degrees: int) -> float:
    """Two-sided probability of a t statistic, by a continued fraction of the incomplete beta function."""
    import math

    x, a, b = degrees / (degrees + t * t), degrees / 2, 0.5

    def fraction(a, b, x):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def rank_change(run: DataFrame, other: DataFrame, k: int = 20) -> DataFrame:
    """The top k of the other run with the change of rank from the first.

    Ranks in the first are counts of the documents before those few, so no query's whole ranking is sorted by one task.
    """
    place = F.round("score", 9).alias("place")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    best = other.select("qid", "doc_id", F.row_number().over(w).alias("r")).filter(F.col("r") <= k).select("qid", "doc_id", F.col("r").cast("long").alias("rank_2"))
    first = run.select("qid", F.col("doc_id").alias("other"), place)
    own = F.broadcast(best.select("qid", "doc_id").join(run.select("qid", "doc_id", place.alias("own")), ["qid", "doc_id"]))  # at most k rows a query
    before = (F.col("place") > F.col("own")) | ((F.col("place") == F.col("own")) & (F.col("other") <= F.col("doc_id")))
    ranks = first.join(own, "qid").filter(before).groupBy("qid", "doc_id").agg(F.count("*").alias("rank_1"))
    return best.join(ranks, ["qid", "doc_id"], "left").select("qid", "doc_id", "rank_2", "rank_1", (F.col("rank_1") - F.col("rank_2")).alias("change"))
