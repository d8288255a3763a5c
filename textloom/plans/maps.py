"""Maps, counters and matrices; token filters and analyzer chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import corpus as c
from textloom.operators import maps as m
from textloom.plans.base import TF, TOKENS, VOCAB, query, r6, table
from textloom.plans.corpus import toks, vectors


def _of_language(spark, d, lang):
    docs = table(spark, d, "documents").filter(F.col("lang") == lang)
    return c.vocabulary(c.doc_vectors(c.tokens(docs)))


_BY_LANG = "tl AS (SELECT lang, term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM tokens JOIN documents USING (doc_id) GROUP BY ALL)"


@query(f"WITH {TOKENS}, {_BY_LANG}, a AS (SELECT * FROM tl WHERE lang = 'en'), b AS (SELECT * FROM tl WHERE lang = 'de') SELECT coalesce(a.term, b.term) AS term, coalesce(a.cf, 0) AS cf_en, coalesce(b.cf, 0) AS cf_de FROM a FULL JOIN b ON a.term = b.term")
def join_vocabularies(spark, d):
    """Two collections' vocabularies side by side."""
    a, b = (_of_language(spark, d, x).select("term", F.col("cf").alias(f"cf_{x}")) for x in ("en", "de"))
    return a.join(b, "term", "full").select("term", *(F.coalesce(f"cf_{x}", F.lit(0)).cast("long").alias(f"cf_{x}") for x in ("en", "de")))


@query(f"WITH {TOKENS}, {_BY_LANG} SELECT term, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(df) AS BIGINT) AS df, count(*) AS n_vocabularies FROM tl GROUP BY term")
def corpus_vocabulary_merge(spark, d):
    docs = table(spark, d, "documents")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang is not None)  # a row a language
    return m.merged_vocabularies([_of_language(spark, d, x) for x in langs])


@query(f"WITH {TF} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM tf GROUP BY doc_id")
def corpus_postings_merge(spark, d):
    """Two runs of postings, of even and odd documents and of all with a remainder of 3, merged."""
    v = vectors(spark, d)
    runs = [v.filter(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1)]
    return m.merged_postings(runs).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query(f"WITH {VOCAB}, ids AS (SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id FROM vocab) SELECT term_id, term, cf FROM ids")
def join_counter_ids(spark, d):
    """A counter of terms as one of ids, and back through the same map."""
    vocab = c.vocabulary(vectors(spark, d))
    ids = c.with_ids(vocab, F.desc("cf")).select("term", "cf", F.col("term_id").cast("long").alias("term_id"))
    by_id = ids.select("term_id", "cf")
    return by_id.join(ids.select("term_id", "term"), "term_id").select("term_id", "term", "cf")


@query("WITH k AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey * 100000 + l_suppkey AS key, l_partkey AS i, l_suppkey AS j, n FROM k")
def map_linear_keys(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).select(m.linear_key(F.col("l_partkey"), F.col("l_suppkey"), 100_000).alias("key"), "n")
    i, j = m.from_linear_key(F.col("key"), 100_000)
    return k.select("key", i.alias("i"), j.alias("j"), "n")


@query("SELECT o_custkey AS a, o_orderstatus AS b, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY ALL")
def agg_list_map_map(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    return g.select("a", "b", "n", F.array_join("o", ",").alias("orders"))


@query("SELECT (SELECT max(doc_id) FROM documents) AS documents, (SELECT max(o_orderkey) FROM orders) AS orders, (SELECT max(event_id) FROM events) AS events")
def agg_max_ids(spark, d):
    one = [table(spark, d, name).agg(F.max(key).alias(name)) for name, key in (("documents", "doc_id"), ("orders", "o_orderkey"), ("events", "event_id"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


@query(f"WITH {VOCAB} SELECT term, cf, df FROM vocab WHERE df >= 0.02 * (SELECT count(DISTINCT doc_id) FROM tf) AND df <= 0.5 * (SELECT count(DISTINCT doc_id) FROM tf)")
def agg_df_selection(spark, d):
    v = vectors(spark, d)
    return m.between_frequencies(c.vocabulary(v), v.select("doc_id").distinct().agg(F.count("*").alias("n")), 0.02, 0.5)


_STOP = f"stop AS (SELECT term FROM vocab ORDER BY cf DESC, term LIMIT 50)"


@query(f"WITH {VOCAB}, {_STOP} SELECT term, cf, df FROM vocab WHERE term IN (SELECT term FROM stop)")
def text_stopword_construction(spark, d):
    """The 50 most frequent terms: the feature is a list of a stated length."""
    return c.vocabulary(vectors(spark, d)).orderBy(F.desc("cf"), "term").limit(50).select("term", "cf", "df")


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n, count(*) FILTER (length(term) BETWEEN 2 AND 20) AS of_length, count(*) FILTER (NOT regexp_full_match(term, '[0-9]+([.,][0-9]+)*')) AS not_numbers, count(*) FILTER (regexp_matches(term, '[\\p{{L}}\\p{{N}}]')) AS not_punctuation FROM tokens GROUP BY doc_id")
def text_token_filters(spark, d):
    x = F.col("term")
    return toks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(t.of_length(x, 2, 20)).alias("of_length"), F.count_if(~t.is_digits(x)).alias("not_numbers"), F.count_if(~t.is_punctuation(x)).alias("not_punctuation"))


@query(f"WITH {VOCAB}, {_STOP}, a AS (SELECT doc_id, CASE WHEN regexp_full_match(term, '[0-9]+([.,][0-9]+)*') THEN '<nu' || length(term) || '>' ELSE term END AS term FROM tokens WHERE length(term) BETWEEN 2 AND 20 AND regexp_matches(term, '[\\p{{L}}\\p{{N}}]') AND term NOT IN (SELECT term FROM stop)) SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_types, min(term) AS first, max(term) AS last FROM a GROUP BY doc_id")
def text_analyzer_chain(spark, d):
    """Tokens, lower case, length, punctuation and stopword filters, number marks."""
    tokens = toks(spark, d)
    stop = [r.term for r in text_stopword_construction(spark, d).select("term").collect()]  # 50 terms
    a = t.analyzed(tokens, stop)
    return a.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_types"), F.min("term").alias("first"), F.max("term").alias("last"))


@query("WITH s AS (SELECT p_partkey AS id, (p_partkey * 7) % 11172 AS k FROM part) SELECT id, chr(CAST(44032 + k AS INT)) AS syllable, chr(CAST(4352 + k // 588 AS INT)) || chr(CAST(4449 + (k % 588) // 28 AS INT)) || CASE WHEN k % 28 > 0 THEN chr(CAST(4519 + k % 28 AS INT)) ELSE '' END AS jamo, true AS same FROM s")
def text_hangul_jamo(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.decode(F.unhex(F.lpad(F.hex((F.lit(44032) + (F.col("p_partkey") * 7) % 11172).cast("long")), 4, "0")), "UTF-16BE").alias("syllable"))
    jamo = t.hangul_decomposed(F.col("syllable"))
    return s.select("id", "syllable", jamo.alias("jamo"), (t.hangul_composed(jamo) == F.col("syllable")).alias("same"))


_PARS = "".join(f", e{k} AS (SELECT doc_id, term, tf, c, tf * 0.1 * p / (0.1 * p + 0.9 * c) AS e FROM p{k}), p{k + 1} AS (SELECT doc_id, term, tf, c, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e{k})" for k in range(3))


@query(f"WITH {VOCAB}, p0 AS (SELECT doc_id, term, tf, cf / (SELECT sum(cf) FROM vocab) AS c, tf / sum(tf) OVER (PARTITION BY doc_id) AS p FROM tf JOIN vocab USING (term)){_PARS} SELECT doc_id, count(*) AS n, round(max(p), 6) AS highest, round(sum(p * p), 6) AS mass FROM p3 GROUP BY doc_id")
def ir_parsimonious(spark, d):
    v = vectors(spark, d)
    p = m.parsimonious(v, c.vocabulary(v))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), r6(F.max("p")).alias("highest"), r6(F.sum(F.col("p") * F.col("p"))).alias("mass"))


_CELLS = "n AS (SELECT l_returnflag AS i, l_linestatus AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {_CELLS}, s AS (SELECT i, j, v FROM n UNION ALL SELECT j, i, v FROM n) SELECT i, j, round(sum(v), 2) AS v FROM s GROUP BY ALL")
def vec_symmetric(spark, d):
    return m.symmetric(_cells(spark, d)).withColumn("v", F.round("v", 2))


@query(f"WITH {_CELLS} SELECT 'row' AS side, i AS name, round(sum(v), 2) AS total, round(avg(v), 4) AS mean FROM n GROUP BY i UNION ALL SELECT 'column', j, round(sum(v), 2), round(avg(v), 4) FROM n GROUP BY j")
def vec_row_column_sums(spark, d):
    cells = _cells(spark, d)
    sums = lambda side, x: cells.groupBy(F.col(x).alias("name")).agg(F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 4).alias("mean")).select(F.lit(side).alias("side"), "name", "total", "mean")
    return sums("row", "i").unionByName(sums("column", "j"))


@query("WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS a FROM embeddings) SELECT l.label, CAST(l.i AS INT) AS i, CAST(r.i AS INT) AS j, round(sum(CAST(l.a AS DOUBLE) * CAST(r.a AS DOUBLE)), 4) AS v FROM x l JOIN x r USING (vec_id) GROUP BY ALL")
def vec_gram_matrix(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    return m.gram_matrix(e, ["label"]).withColumn("v", F.round("v", 4))
