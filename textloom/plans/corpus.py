"""Dictionaries, joins, aggregates, ranks and windows over tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import corpus as c
from textloom.plans.base import STATS, TERMS, TF, TOKENS, TOPIC, VOCAB, query, r6, table, topics

_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


def toks(spark, d, only=None):
    return c.tokens(table(spark, d, "documents"), only=only)


def vectors(spark, d, only=None):
    return c.doc_vectors(toks(spark, d, only))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_types, max(pos) AS last_pos FROM tokens GROUP BY doc_id")
def corpus_tokens(spark, d):
    return toks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_types"), F.max("pos").alias("last_pos"))


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def corpus_doc_vectors(spark, d):
    return vectors(spark, d)


@query(f"WITH {VOCAB} SELECT term, cf, df, round(cf / (SELECT sum(cf) FROM vocab), 9) AS p FROM vocab")
def corpus_vocabulary(spark, d):
    vocab = c.vocabulary(vectors(spark, d))
    total = vocab.agg(F.sum("cf").alias("total"))
    return vocab.join(F.broadcast(total)).select("term", "cf", "df", F.round(F.col("cf") / F.col("total"), 9).alias("p"))


@query(f"WITH {VOCAB}, f AS (SELECT CASE WHEN cf < 5 OR length(term) > 100 THEN '<unk>' ELSE term END AS term, cf, df FROM vocab), g AS (SELECT term, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(df) AS BIGINT) AS df FROM f GROUP BY term) SELECT *, row_number() OVER (ORDER BY df, term) - 1 AS term_id FROM g")
def corpus_folded_vocabulary(spark, d):
    return c.with_ids(c.folded_vocabulary(vectors(spark, d)), F.col("df").asc())


@query(f"WITH {VOCAB}, f AS (SELECT CASE WHEN cf < 5 THEN '<unk>' ELSE term END AS term, cf, df FROM vocab), g AS (SELECT term, sum(df) AS df FROM f GROUP BY term), i AS (SELECT term, row_number() OVER (ORDER BY df, term) - 1 AS term_id FROM g) SELECT doc_id, count(*) AS n, CAST(sum(coalesce(i.term_id, u.term_id)) AS BIGINT) AS id_sum, count_if(i.term_id IS NULL) AS unknown FROM tokens LEFT JOIN i USING (term), (SELECT term_id FROM i WHERE term = '<unk>') u GROUP BY doc_id")
def corpus_encoding(spark, d):
    t = toks(spark, d)
    vocab = c.with_ids(c.folded_vocabulary(c.doc_vectors(t)), F.col("df").asc())
    unk = vocab.filter("term = '<unk>'").select(F.col("term_id").alias("unk"))
    return c.encode(t, vocab).join(F.broadcast(unk)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("term_id").alias("id_sum"), F.count_if(F.col("term_id") == F.col("unk")).alias("unknown"))


@query(f"WITH {VOCAB}, f AS (SELECT CASE WHEN cf < 5 THEN '<unk>' ELSE term END AS term, cf, df FROM vocab), g AS (SELECT term, sum(df) AS df FROM f GROUP BY term) SELECT doc_id, count(*) AS known FROM tokens JOIN g USING (term) GROUP BY doc_id")
def corpus_known_only_decode(spark, d):
    t = toks(spark, d)
    vocab = c.with_ids(c.folded_vocabulary(c.doc_vectors(t)), F.col("df").asc())
    return c.decode(c.encode(t, vocab, known_only=True), vocab).groupBy("doc_id").agg(F.count("*").alias("known"))


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ' ') AS positions FROM tokens WHERE term IN ({_TERM_LIST}) GROUP BY term, doc_id")
def corpus_postings(spark, d):
    return c.postings(toks(spark, d, TERMS)).select("term", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, md5(array_to_string(list(pos ORDER BY pos), ' ')) AS positions FROM tokens GROUP BY term, doc_id")
def corpus_postings_all(spark, d):
    """The same for all terms; of the positions a digest."""
    return c.postings(toks(spark, d)).select("term", "doc_id", "tf", F.md5(F.array_join("positions", " ").cast("binary")).alias("positions"))


@query(f"WITH {STATS} SELECT n_docs, n_tokens, round(avg_dl, 6) AS avg_dl, min_dl, max_dl FROM cs")
def corpus_stats(spark, d):
    return c.collection_stats(vectors(spark, d)).withColumn("avg_dl", r6("avg_dl"))


@query(f"WITH {TF} SELECT source, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_types, CAST(sum(tf) AS BIGINT) AS n_tokens, round(sum(tf) / count(DISTINCT doc_id), 6) AS avg_dl FROM tf JOIN documents USING (doc_id) GROUP BY source")
def corpus_stats_by_collection(spark, d):
    v = vectors(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    terms = v.groupBy("source", "term").agg(F.sum("tf").alias("tf")).groupBy("source").agg(F.count("*").alias("n_types"), F.sum("tf").alias("n_tokens"))
    docs = v.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg(F.count("*").alias("n_docs"))
    return docs.join(terms, "source").select("source", "n_docs", "n_types", "n_tokens", r6(F.col("n_tokens") / F.col("n_docs")).alias("avg_dl"))


@query(f"WITH {TF} SELECT lang, term, CAST(sum(tf) AS BIGINT) AS n FROM tf JOIN documents USING (doc_id) WHERE term IN ({_TERM_LIST}) GROUP BY ROLLUP (term, lang)")
def corpus_collection_counts(spark, d):
    v = vectors(spark, d, TERMS).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return v.rollup("term", "lang").agg(F.sum("tf").alias("n")).select("lang", "term", "n")


@query(f"WITH {TF} SELECT lang, term, CAST(sum(tf) AS BIGINT) AS n FROM tf JOIN documents USING (doc_id) GROUP BY ROLLUP (term, lang)")
def corpus_collection_counts_all(spark, d):
    v = vectors(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return v.rollup("term", "lang").agg(F.sum("tf").alias("n")).select("lang", "term", "n")


@query(f"WITH {VOCAB} SELECT cf AS freq, count(*) AS n FROM vocab GROUP BY cf")
def agg_freq_of_freq(spark, d):
    return c.vocabulary(vectors(spark, d)).groupBy(F.col("cf").alias("freq")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS top, min(value) AS low FROM events GROUP BY user_id, event_type")
def agg_counter_map(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"), r6(F.avg("value")).alias("mean"), F.max("value").alias("top"), F.min("value").alias("low"))


@query("SELECT n_name, o_orderpriority, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderpriority, o_orderstatus)")
def agg_counter_map_map(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.cube("n_name", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, array_to_string(list_sort(list(p_partkey)), ',') AS parts, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY p_brand")
def agg_list_and_set_map(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("parts"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type")
def agg_set_map_invert(spark, d):
    by_brand = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    return by_brand.select("p_brand", F.explode("types").alias("p_type")).groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query(f"WITH {TF}, m AS (SELECT doc_id, max(tf) AS t FROM tf GROUP BY doc_id) SELECT tf.doc_id, min(term) AS top_term, t AS top_tf FROM tf JOIN m ON tf.doc_id = m.doc_id AND tf = t GROUP BY tf.doc_id, t")
def agg_arg_max(spark, d):
    best = F.max(F.struct("tf", F.lit(0))).alias("m")
    v = vectors(spark, d)
    top = v.groupBy("doc_id").agg(best).select("doc_id", F.col("m.tf").alias("top_tf"))
    return v.join(top, "doc_id").filter("tf = top_tf").groupBy("doc_id", "top_tf").agg(F.min("term").alias("top_term")).select("doc_id", "top_term", "top_tf")


@query("SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS p, round(greatest(count(*) - 0.5, 0) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS discounted, round(ln(count(*)), 6) AS log_n FROM events GROUP BY user_id, event_type")
def agg_normalize(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    return n.select("user_id", "event_type", r6(F.col("n") / F.sum("n").over(w)).alias("p"), r6(F.greatest(F.col("n") - 0.5, F.lit(0.0)) / F.sum("n").over(w)).alias("discounted"), r6(F.log("n")).alias("log_n"))


@query(f"WITH {VOCAB} SELECT term, cf FROM vocab WHERE cf >= 50")
def agg_prune(spark, d):
    return c.vocabulary(vectors(spark, d)).filter("cf >= 50").select("term", "cf")


@query(f"WITH {TF} SELECT doc_id, count(*) AS n_numbers FROM tokens WHERE regexp_matches(term, '[0-9]') GROUP BY doc_id")
def agg_numeric_tokens(spark, d):
    return toks(spark, d).filter(F.col("term").rlike("[0-9]")).groupBy("doc_id").agg(F.count("*").alias("n_numbers"))


@query(f"WITH {TOKENS} SELECT term AS w1, w2, count(*) AS n FROM (SELECT term, pos, lead(term) OVER w AS w2, lead(pos) OVER w AS p2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE p2 = pos + 1 GROUP BY ALL HAVING count(*) >= 5")
def agg_bigrams(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = toks(spark, d).select(F.col("term").alias("w1"), "pos", F.lead("term").over(w).alias("w2"), F.lead("pos").over(w).alias("p2"))
    return t.filter("p2 = pos + 1").groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n >= 5")


def _pairs_sql(reach: int, symmetric: bool) -> str:
    parts = " UNION ALL ".join(f"SELECT term AS l, lead(term, {k}) OVER w AS r, lead(pos, {k}) OVER w - pos AS gap FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)" for k in range(1, reach + 1))
    both = "SELECT l, r, gap FROM p UNION ALL SELECT r, l, gap FROM p" if symmetric else "SELECT * FROM p"
    return f"WITH {TOKENS}, p AS (SELECT * FROM ({parts}) WHERE r IS NOT NULL AND gap <= {reach}), b AS ({both}) SELECT l AS \"left\", r AS \"right\", round(sum(1.0 / gap), 6) AS weight, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 5"


@query(_pairs_sql(3, True))
def agg_cooccurrence(spark, d):
    return c.cooccurrence(table(spark, d, "documents"), 3, 5, symmetric=True).withColumn("weight", r6("weight"))


@query(_pairs_sql(2, False))
def agg_hal_proximity(spark, d):
    return c.cooccurrence(table(spark, d, "documents"), 3, 5, inclusive=False).withColumn("weight", r6("weight"))


@query(f"WITH {TF}, i AS (SELECT term, doc_id FROM tf WHERE term IN ('the', 'and')) SELECT a.doc_id FROM i a JOIN i b ON a.doc_id = b.doc_id WHERE a.term = 'the' AND b.term = 'and'")
def join_intersection(spark, d):
    v = vectors(spark, d, ["the", "and"])
    return v.filter("term = 'the'").select("doc_id").join(v.filter("term = 'and'").select("doc_id"), "doc_id")


def _next_sql(x: str, y: str, window: int) -> str:
    return f"SELECT doc_id, pos AS start, e AS \"end\" FROM (SELECT *, min(CASE WHEN term = '{y}' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM tokens WHERE term IN ('{x}', '{y}')) WHERE term = '{x}' AND e - pos <= {window}"


@query(f"WITH {TOKENS} " + _next_sql("the", "and", 5))
def join_collocation_ordered(spark, d):
    return c.collocations(toks(spark, d, ["the", "and"]), "the", "and", 5)


@query(f"WITH {TOKENS} {_next_sql('the', 'and', 5)} UNION {_next_sql('and', 'the', 5)}")
def join_collocation_unordered(spark, d):
    return c.collocations(toks(spark, d, ["the", "and"]), "the", "and", 5, ordered=False)


@query(f"WITH {TOKENS} SELECT a.doc_id, a.pos AS start, CAST(a.pos + 1 AS INT) AS \"end\" FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def join_phrase(spark, d):
    return c.phrase(toks(spark, d, ["of", "the"]), ["of", "the"])


@query(f"WITH {TF}, {TOPIC} SELECT qid, doc_id, count(*) AS matched FROM tf JOIN q USING (term) GROUP BY qid, doc_id")
def join_boolean_match(spark, d):
    return vectors(spark, d, TERMS).join(F.broadcast(topics(spark)), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("matched"))


@query(f"WITH {TF}, a AS (SELECT term, sum(tf) AS n FROM tf JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY term), b AS (SELECT term, sum(tf) AS n FROM tf JOIN documents USING (doc_id) WHERE lang = 'fr' GROUP BY term) SELECT term, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS diff FROM a FULL JOIN b USING (term)")
def join_counter_difference(spark, d):
    v = vectors(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    signed = F.when(F.col("lang") == "en", F.col("tf")).otherwise(-F.col("tf"))
    return v.filter("lang IN ('en', 'fr')").groupBy("term").agg(F.sum(signed).alias("diff"))


def _lang_terms(spark, d, lang):
    docs = table(spark, d, "documents").filter(F.col("lang") == lang)
    return c.tokens(docs).select("term").distinct()


@query(f"WITH {TF}, t AS (SELECT DISTINCT lang, term FROM tf JOIN documents USING (doc_id)) (SELECT term FROM t WHERE lang = 'en' EXCEPT SELECT term FROM t WHERE lang = 'fr')")
def join_key_difference(spark, d):
    return _lang_terms(spark, d, "en").join(_lang_terms(spark, d, "fr"), "term", "left_anti")


@query(f"WITH {TF}, t AS (SELECT DISTINCT lang, term FROM tf JOIN documents USING (doc_id)) (SELECT term FROM t WHERE lang = 'en' INTERSECT SELECT term FROM t WHERE lang = 'de')")
def join_key_intersection(spark, d):
    return _lang_terms(spark, d, "en").join(_lang_terms(spark, d, "de"), "term", "left_semi")


@query("SELECT k, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT c_mktsegment AS k, 1.0 AS n FROM customer UNION ALL SELECT o_orderpriority, 0.5 FROM orders) GROUP BY k")
def join_union_sum(spark, d):
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), F.lit(1.0).alias("n"))
    b = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.lit(0.5).alias("n"))
    return a.unionByName(b).groupBy("k").agg(F.sum("n").alias("n"))


@query("SELECT p_brand AS phrase, count(*) AS n, count(DISTINCT p_type) AS sources FROM part GROUP BY p_brand")
def join_dictionary_merge(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("phrase")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("sources"))


@query(f"WITH {VOCAB} SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM vocab QUALIFY rank <= 100")
def rank_top_keys(spark, d):
    top = c.vocabulary(vectors(spark, d)).orderBy(F.desc("cf"), "term").limit(100).select("term", "cf")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "term")).cast("long"))


@query(f"WITH {TF} SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM tf QUALIFY rank <= 5")
def rank_doc_top_terms(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return vectors(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5")


@query("SELECT p_brand, p_partkey, p_retailprice, rank() OVER w AS r, dense_rank() OVER w AS dr, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING), 4) AS running FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC)")
def rank_transform_and_cumulate(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    run = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.round(F.sum("p_retailprice").over(run), 4).alias("running"))


@query("SELECT vec_id, slice, round(value, 6) AS value FROM (SELECT vec_id, unnest(range(1, 9)) AS slice, unnest(list_slice(embedding, 9, 16)) AS value FROM embeddings)")
def rank_sub_vector(spark, d):
    cut = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 9, 8)).alias("slice", "value"))
    return cut.select("vec_id", (F.col("slice") + 1).cast("long").alias("slice"), F.round(F.col("value"), 6).alias("value"))


@query(f"WITH {TOKENS} SELECT doc_id, CAST(floor(pos / 500) AS BIGINT) AS passage, count(*) AS n FROM tokens GROUP BY ALL")
def window_tumbling_passages(spark, d):
    return c.passages(toks(spark, d), 500).groupBy("doc_id", "passage").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT doc_id, passage, count(*) AS n FROM (SELECT doc_id, unnest(range(greatest(0, CAST(floor((pos - 1000) / 500.0) AS BIGINT) + 1), CAST(floor(pos / 500.0) AS BIGINT) + 1)) AS passage FROM tokens) GROUP BY ALL")
def window_sliding_passages(spark, d):
    return c.passages(toks(spark, d), 1000, 500).groupBy("doc_id", "passage").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT * FROM (SELECT doc_id, pos, term, coalesce(string_agg(term, ' ' ORDER BY pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(term, ' ' ORDER BY pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM tokens) WHERE term IN ('le', 'und')")
def window_context(spark, d):
    return c.context(toks(spark, d), 2).filter("term IN ('le', 'und')").withColumn("before", F.array_join("before", " ")).withColumn("after", F.array_join("after", " "))


@query(f"WITH {TOKENS} SELECT * FROM (SELECT doc_id, pos, term, coalesce(string_agg(term, ' ' ORDER BY pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(term, ' ' ORDER BY pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM tokens)")
def window_context_all(spark, d):
    return c.context(toks(spark, d), 2).withColumn("before", F.array_join("before", " ")).withColumn("after", F.array_join("after", " "))


@query("WITH n AS (SELECT l_returnflag AS i, l_linestatus AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) AS by_column, round(v / sum(v) OVER (PARTITION BY i), 6) AS by_row, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS min_max FROM n")
def window_matrix_normalization(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.sum("l_quantity").alias("v"))
    ends = n.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return n.join(F.broadcast(ends)).select("i", "j", r6(F.col("v") / F.sum("v").over(Window.partitionBy("j"))).alias("by_column"), r6(F.col("v") / F.sum("v").over(Window.partitionBy("i"))).alias("by_row"), r6((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("min_max"))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS BIGINT) AS fold, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 0.8 * count(*) OVER (PARTITION BY lang) THEN 'train' ELSE 'test' END AS part FROM documents")
def split_stratified(spark, d):
    w = Window.partitionBy("lang")
    r = F.row_number().over(w.orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", ((r - 1) % 5).cast("long").alias("fold"), F.when(r <= 0.8 * F.count("*").over(w), "train").otherwise("test").alias("part"))


@query()
def agg_weighted_sample(spark, d):
    """A draw of terms in proportion to their counts, without replacement: the least exponentials of rate cf."""
    vocab = c.vocabulary(vectors(spark, d))
    return vocab.withColumn("key", -F.log(F.rand(7)) / F.col("cf")).orderBy("key").limit(50).select("term", "cf")
