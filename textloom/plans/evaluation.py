"""Evaluation: runs of the retrieval plans against documents' sources as judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluation as e
from textloom.operators import retrieval as r
from textloom.plans.base import query, r6, table, topics
from textloom.plans.retrieval import _BM25, _DIR, _M, index

_QRELS = "qrels AS (SELECT qid, doc_id, CASE WHEN lang = CASE qid WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' WHEN 4 THEN 'es' ELSE 'en' END THEN 1 + quality ELSE 0 END AS rel FROM documents JOIN labels USING (doc_id), (SELECT DISTINCT qid FROM q))"
_QL = f"SELECT qid, doc_id, sum(qtf * ln({_DIR})) AS score FROM k GROUP BY qid, doc_id"


def qrels(spark, d):
    """Five topics: the documents of a topic's language are relevant, those of good quality more so."""
    lang = F.element_at(F.create_map(*(F.lit(x) for p in ((1, "en"), (2, "fr"), (3, "de"), (4, "es"), (5, "en")) for x in p)), F.col("qid"))
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return docs.join(F.broadcast(topics(spark).select("qid").distinct())).select("qid", "doc_id", F.when(F.col("lang") == lang, 1 + F.col("quality")).otherwise(0).alias("rel"))


def _eval_sql(run: str, name: str) -> str:
    return f"""{name}_j AS (SELECT x.*, coalesce(rel, 0) AS rel, rel IS NOT NULL AS judged FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({run})) x LEFT JOIN qrels USING (qid, doc_id) WHERE rank <= 1000),
{name}_r AS (SELECT j.*, relevant, nonrelevant, sum(CAST(rel > 0 AS INT)) OVER w AS hits, sum(CAST(judged AND rel <= 0 AS INT)) OVER w AS misses, row_number() OVER (PARTITION BY j.qid ORDER BY rel DESC, rank) AS best FROM {name}_j j JOIN (SELECT qid, count_if(rel > 0) AS relevant, count_if(rel <= 0) AS nonrelevant FROM qrels GROUP BY qid) t USING (qid) WINDOW w AS (PARTITION BY qid ORDER BY rank)),
{name}_a AS (SELECT qid, count(*) AS retrieved, any_value(relevant) AS relevant, CAST(count_if(rel > 0) AS BIGINT) AS rel_ret, count_if(rel > 0 AND rank <= 10) / 10.0 AS p_n, count_if(rel > 0 AND rank <= 10) / any_value(relevant) AS r_n, sum(CAST(rel > 0 AS INT) * hits / rank) / any_value(relevant) AS ap,
  sum(CASE WHEN rank <= 10 THEN (power(2.0, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (power(2.0, rel) - 1) / log2(best + 1) ELSE 0 END) AS ideal, coalesce(1.0 / min(CASE WHEN rel > 0 THEN rank END), 0.0) AS rr, 0.2 * sum(CAST(rel > 0 AS INT) * power(0.8, rank - 1)) AS rbp,
  sum(CASE WHEN rel > 0 THEN 1 - least(misses, nonrelevant) / greatest(nonrelevant, 1) ELSE 0 END) / greatest(any_value(relevant), 1) AS bpref FROM {name}_r GROUP BY qid),
{name} AS (SELECT qid, retrieved, relevant, rel_ret, p_n, r_n, CASE WHEN p_n + r_n > 0 THEN 2 * p_n * r_n / (p_n + r_n) ELSE 0 END AS f1, ap, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, rr, rbp, bpref FROM {name}_a)"""


_COLS = ("p_n", "r_n", "f1", "ap", "ndcg", "rr", "rbp", "bpref")


def rounded(df, *keys):
    return df.select(*keys, *(r6(F.col(c).cast("double")).alias(c) for c in df.columns if c not in keys))


def runs(spark, d):
    i = index(spark, d)
    return r.bm25(i, topics(spark)), r.language_model(i, topics(spark), "ql")


@query(f"{_M}, {_QRELS}, {_eval_sql(_BM25, 'ev')} SELECT qid, retrieved, relevant, rel_ret, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _COLS)} FROM ev")
def eval_per_query(spark, d):
    return rounded(e.evaluate(runs(spark, d)[0], qrels(spark, d)), "qid", "retrieved", "relevant", "rel_ret")


@query(f"{_M}, {_QRELS}, {_eval_sql(_BM25, 'ev')} SELECT count(*) AS queries, CAST(sum(retrieved) AS BIGINT) AS retrieved, CAST(sum(relevant) AS BIGINT) AS relevant, CAST(sum(rel_ret) AS BIGINT) AS rel_ret, {', '.join(f'round(CAST(avg({c}) AS DOUBLE), 6) AS mean_{c}' for c in _COLS)} FROM ev")
def eval_summary(spark, d):
    return rounded(e.summary(e.evaluate(runs(spark, d)[0], qrels(spark, d))), "queries", "retrieved", "relevant", "rel_ret")


@query(f"{_M}, {_QRELS}, {_eval_sql(_BM25, 'ea')}, {_eval_sql(_QL, 'eb')}, x AS (SELECT ea.ap AS a, eb.ap AS b, eb.ap - ea.ap AS d FROM ea JOIN eb USING (qid)) SELECT count(*) AS queries, round((avg(b) - avg(a)) / avg(a), 6) AS improvement, round(sum(sign(d)) / count(*), 6) AS robustness, round(avg(greatest(0, -d)), 6) AS risk, round(avg(greatest(0, d)), 6) AS reward, round(avg(greatest(0, d)) - 2 * avg(greatest(0, -d)), 6) AS tradeoff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM x")
def eval_compare(spark, d):
    a, b = runs(spark, d)
    q = qrels(spark, d)
    return rounded(e.compare(e.evaluate(a, q), e.evaluate(b, q)), "queries")


@query(f"{_M}, a AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank_1 FROM ({_BM25})), b AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank_2 FROM ({_QL})) SELECT qid, doc_id, rank_2, rank_1, rank_1 - rank_2 AS change FROM b LEFT JOIN a USING (qid, doc_id) WHERE rank_2 <= 20")
def eval_rank_change(spark, d):
    return e.rank_change(*runs(spark, d))


@query(f"{_M}, {_QRELS}, a AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({_BM25})) SELECT qid, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks FROM a JOIN qrels USING (qid, doc_id) WHERE rel > 0 AND rank <= 50 GROUP BY qid")
def eval_relevant_ranks(spark, d):
    j = e.judged(runs(spark, d)[0], qrels(spark, d)).filter("rel > 0 AND rank <= 50")
    return j.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("rank")), ",").alias("ranks"))


@query(f"{_M}, {_QRELS}, s AS ({_BM25}) SELECT qid, count(*) AS judged FROM s LEFT SEMI JOIN qrels USING (qid, doc_id) GROUP BY qid".replace("LEFT SEMI", "SEMI"))
def eval_judged_only(spark, d):
    return runs(spark, d)[0].join(qrels(spark, d), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("judged"))
