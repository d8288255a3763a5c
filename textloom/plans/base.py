"""Registration of queries, tables, and common table expressions of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) with the SQL of the same rows."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The fixed queries of the retrieval plans: terms that are frequent in some language.
TOPICS = [(1, "the and an"), (2, "le la de"), (3, "und der in"), (4, "que de los"), (5, "the ing er and")]
TERMS = sorted({t for _, q in TOPICS for t in q.split()})


def topics(spark: SparkSession) -> DataFrame:
    """qid, q_pos, term, qtf."""
    rows = [(q, i, t, 1) for q, text in TOPICS for i, t in enumerate(text.split())]
    return spark.createDataFrame(rows, "qid int, q_pos int, term string, qtf int")


def r6(c) -> F.Column:
    return F.round(c, 6)


_TOPIC_ROWS = ", ".join(f"({q}, {i}, '{t}', 1)" for q, text in TOPICS for i, t in enumerate(text.split()))
WORDS = """words AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))), '\\s*\\n\\s*', ' </s> ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM documents)"""
TOKENS = WORDS + """, tokens AS (SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS term FROM words) WHERE term <> '</s>')"""
TF = TOKENS + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL)"
VOCAB = TF + ", vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)"
STATS = VOCAB + ", dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY doc_id), cs AS (SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_tokens, avg(dl) AS avg_dl, min(dl) AS min_dl, max(dl) AS max_dl FROM dl)"
TOPIC = f"q(qid, q_pos, term, qtf) AS (VALUES {_TOPIC_ROWS})"
