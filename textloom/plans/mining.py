"""Phrases, abbreviations, keyphrases, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import corpus as c
from textloom.operators import mining as m
from textloom.plans.base import TERMS, TOKENS, query, r6, table

_S = "sl AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '\\n+'), lambda s: list_filter(string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')), lambda s: len(s) > 0) AS s FROM documents), se AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS sent_id, unnest(s) AS w FROM sl), st AS (SELECT doc_id, sent_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS term FROM se)"
_STOP = ", ".join(f"'{t}'" for t in TERMS)


def _grams(n: int) -> str:
    parts = " || ' ' || ".join(["term", *(f"lead(term, {k}) OVER w" for k in range(1, n))])
    return f"SELECT doc_id, {n} AS words, {parts} AS phrase FROM st WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)"


_FREQ = "fp AS (SELECT phrase, CAST(words AS BIGINT) AS words, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({}) WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {})"


@query(f"WITH {_S}, {_FREQ.format(' UNION ALL '.join(map(_grams, (2, 3, 4))), 5)} SELECT * FROM fp")
def mine_frequent_phrases(spark, d):
    return m.frequent_phrases(table(spark, d, "documents"))


@query(f"WITH {_S}, {_FREQ.format(' UNION ALL '.join(map(_grams, (2, 3))), 5)} SELECT phrase, n FROM fp WHERE NOT regexp_matches(phrase, '^[[:punct:]]|[[:punct:]]$') AND len(list_filter(string_split(phrase, ' '), lambda t: t NOT IN ({_STOP}))) > 0 AND length(regexp_replace(phrase, '[^(\\[{{]', '', 'g')) = length(regexp_replace(phrase, '[^)\\]}}]', '', 'g'))")
def mine_phrase_filter(spark, d):
    return m.frequent_phrases(table(spark, d, "documents"), 5, 3).filter(m.good_phrase(F.col("phrase"), TERMS)).select("phrase", "n")


@query(f"WITH {TOKENS}, ph(phrase) AS (VALUES ('of the'), ('in the'), ('de la'), ('to the an')), g AS (SELECT doc_id, pos AS start, unnest([{{'p': term, 'e': pos}}, CASE WHEN lead(pos, 1) OVER w = pos + 1 THEN {{'p': term || ' ' || lead(term, 1) OVER w, 'e': CAST(pos + 1 AS INT)}} END, CASE WHEN lead(pos, 2) OVER w = pos + 2 THEN {{'p': term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w, 'e': CAST(pos + 2 AS INT)}} END]) AS x FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, start, x.e AS \"end\", x.p AS phrase FROM g JOIN ph ON x.p = phrase")
def mine_phrase_mapping(spark, d):
    known = spark.createDataFrame([("of the",), ("in the",), ("de la",), ("to the an",)], "phrase string")
    return m.map_phrases(c.tokens(table(spark, d, "documents")), known, 3)


@query(f"WITH {TOKENS}, o AS (SELECT term, count(*) AS n FROM tokens GROUP BY term), pr AS (SELECT term AS w1, lead(term) OVER w AS w2, pos, lead(pos) OVER w AS p2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), t AS (SELECT w1, w2, count(*) AS n FROM pr WHERE p2 = pos + 1 GROUP BY ALL), s AS (SELECT (SELECT sum(n) FROM t) AS n2, (SELECT sum(n) FROM o) AS n1), v AS (SELECT w1, w2, t.n, ln(t.n / n2) - ln(a.n / n1) - ln(b.n / n1) AS pmi, -ln(t.n / n2) AS h FROM t JOIN o a ON a.term = w1 JOIN o b ON b.term = w2, s WHERE t.n >= 5) SELECT w1, w2, n, round(pmi, 6) AS pmi, round(pmi / h, 6) AS npmi FROM v")
def mine_pmi(spark, d):
    return m.pmi(c.tokens(table(spark, d, "documents"))).withColumn("pmi", r6("pmi")).withColumn("npmi", r6("npmi"))


@query(f"WITH {_S}, {_FREQ.format(' UNION ALL '.join(map(_grams, (2, 3))), 3)}, ok AS (SELECT phrase, df FROM fp WHERE NOT regexp_matches(phrase, '^[[:punct:]]|[[:punct:]]$') AND len(list_filter(string_split(phrase, ' '), lambda t: t NOT IN ({_STOP}))) > 0 AND length(regexp_replace(phrase, '[^(\\[{{]', '', 'g')) = length(regexp_replace(phrase, '[^)\\]}}]', '', 'g'))), f AS (SELECT doc_id, phrase, count(*) AS tf FROM ({_grams(2)} UNION ALL {_grams(3)}) SEMI JOIN ok USING (phrase) GROUP BY ALL), s AS (SELECT doc_id, phrase, tf, tf * ln(((SELECT count(DISTINCT doc_id) FROM st) + 1) / df) AS score FROM f JOIN ok USING (phrase)) SELECT doc_id, phrase, tf, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS rank FROM s QUALIFY rank <= 5")
def mine_keyphrases(spark, d):
    return m.keyphrases(table(spark, d, "documents"), TERMS).withColumn("score", r6("score"))


@query()
def mine_abbreviations(spark, d):
    """Short and long forms; held against small texts in tests."""
    return m.abbreviations(table(spark, d, "documents")).groupBy("short").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("long")).alias("long_forms"))


@query()
def mine_sequential_patterns(spark, d):
    """Sequential patterns of event types of users."""
    from pyspark.ml.fpm import PrefixSpan

    events = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: F.array(e["event_type"])).alias("sequence"))
    found = PrefixSpan(minSupport=0.3, maxPatternLength=3).findFrequentSequentialPatterns(events)
    return found.select(F.array_join(F.flatten("sequence"), " ").alias("pattern"), F.col("freq").alias("n"))


def _walk_sql(rounds: int) -> str:
    steps, last = [], "SELECT node, b AS score FROM sh"
    for k in range(rounds):
        steps.append(f"r{k} AS ({last})")
        last = f"SELECT sh.node, 0.85 * coalesce(m.m, 0) + 0.15 * sh.b AS score FROM sh LEFT JOIN (SELECT dst AS node, sum(w * score) AS m FROM e JOIN r{k} ON r{k}.node = e.src GROUP BY dst) m ON m.node = sh.node"
    return f"{', '.join(steps)}, walk AS ({last})"


_EDGES = "raw AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM raw), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), sh AS (SELECT node, 1.0 / (SELECT count(*) FROM nd) AS b FROM nd)"


@query(f"WITH {_EDGES}, {_walk_sql(5)} SELECT node, round(score, 6) AS score FROM walk")
def graph_random_walk(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = o.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w"))
    return m.random_walk(edges, 5).withColumn("score", r6("score"))


@query("WITH RECURSIVE l AS (SELECT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_size < 20 AND p_partkey + 7 < 2000), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS least FROM both_ways UNION SELECT b, least FROM r JOIN both_ways ON a = node WHERE least < b) SELECT node, min(least) AS least FROM r GROUP BY node")
def graph_components(spark, d):
    p = table(spark, d, "part").filter("p_size < 20 AND p_partkey + 7 < 2000")
    return m.connected(p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b")))


@query()
def graph_components_all(spark, d):
    """The same over all parts, whatever their ids; without SQL, held against union-find in a test."""
    p = table(spark, d, "part").filter("p_size < 20")
    return m.connected(p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b")))


@query("SELECT doc_id, regexp_extract(text, '(?i)licensed under ([^.\\n]+)', 1) AS name FROM documents WHERE regexp_matches(text, '(?i)licensed under [^.\\n]+')")
def mine_pattern_entities(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike(r"(?i)licensed under [^.\n]+")).select("doc_id", F.regexp_extract("text", r"(?i)licensed under ([^.\n]+)", 1).alias("name"))
