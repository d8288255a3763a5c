"""Vectors, classifiers and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import codecs
from textloom.functions import vector as v
from textloom.operators import corpus as c
from textloom.operators import ml
from textloom.plans.base import TF, query, r6, table

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query(f"WITH {_E}, p AS (SELECT a.vec_id, a.vec AS a, b.vec AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS euclid, round(sqrt(list_dot_product(a, a)), 6) AS norm2, round(list_sum(list_transform(a, lambda x: abs(x))), 6) AS norm1 FROM p")
def vec_kernels(spark, d):
    e = emb(spark, d)
    p = e.select("vec_id", F.col("vec").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", *(r6(x).alias(n) for n, x in (("dot", v.dot(a, b)), ("cosine", v.cosine(a, b)), ("euclid", v.euclidean(a, b)), ("norm2", v.norm2(a)), ("norm1", v.norm1(a)))))


@query(f"WITH {_E}, s AS (SELECT vec_id, list_transform(vec, lambda x: exp(x - list_max(vec))) AS x FROM e), p AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM s), q AS (SELECT a.vec_id, a.p, b.p AS q FROM p a JOIN p b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(p[1], 6) AS first, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS kl, round((list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / ((z[1] + z[2]) / 2)))) + list_sum(list_transform(list_zip(p, q), lambda z: z[2] * ln(z[2] / ((z[1] + z[2]) / 2))))) / 2, 6) AS js, round(exp(list_sum(list_transform(p, lambda x: ln(x))) / len(p)), 6) AS geometric FROM q")
def vec_distributions(spark, d):
    e = emb(spark, d).select("vec_id", v.softmax(F.col("vec")).alias("p"))
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    p, q = F.col("p"), F.col("q")
    return x.select("vec_id", *(r6(y).alias(n) for n, y in (("first", p[0]), ("entropy", v.entropy(p)), ("kl", v.kl(p, q)), ("js", v.js(p, q)), ("geometric", v.geometric_mean(p)))))


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(vec, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid, round(list_sum(list_transform(vec, lambda x: (exp(x) - exp(-x)) / (exp(x) + exp(-x)))), 6) AS tanh, round(list_sum(list_transform(vec, lambda x: greatest(x, 0))), 6) AS relu, round(list_sum(list_transform(vec, lambda x: CASE WHEN x > 0 THEN x ELSE 0.01 * x END)), 6) AS leaky_relu, round(list_sum(list_transform(vec, lambda x: x / (1 + abs(x)))), 6) AS softsign, round(list_sum(list_transform(vec, lambda x: greatest(0, least(1, 0.2 * x + 0.5)))), 6) AS hard_sigmoid, round(list_sum(list_transform(vec, lambda x: greatest(-1, least(1, x)))), 6) AS hard_tanh, list_position(vec, list_max(vec)) - 1 AS arg_max FROM e")
def vec_elementwise(spark, d):
    x = F.col("vec")
    return emb(spark, d).select("vec_id", *(r6(v.total(v.activate(x, n))).alias(n) for n in v.ACTIVATIONS), v.arg_max(x).cast("int").alias("arg_max"))


@query(f"WITH {_E}, m AS (SELECT label, generate_subscripts(vec, 1) - 1 AS i, unnest(vec) AS x FROM e) SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS deviation FROM m GROUP BY label, i")
def vec_moments(spark, d):
    x = emb(spark, d).select("label", F.posexplode("vec").alias("i", "x"))
    return x.groupBy("label", "i").agg(r6(F.avg("x")).alias("mean"), r6(F.var_samp("x")).alias("variance"), r6(F.stddev_samp("x")).alias("deviation"))


@query(f"WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.vec, e.vec) AS cosine FROM q, e WHERE q.vec_id <> e.vec_id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, id) AS rank, round(cosine, 6) AS cosine FROM s QUALIFY rank <= 10")
def vec_nearest(spark, d):
    e = emb(spark, d).select(F.col("vec_id").alias("id"), "vec")
    return ml.nearest(e, e.filter("id % 50 = 0").withColumnRenamed("id", "qid")).select("qid", "id", "rank", r6("cosine").alias("cosine"))


@query(f"WITH {_E}, q AS (SELECT list_transform(range(1, 65), lambda i: b.vec[i] - a.vec[i] + c.vec[i]) AS vec FROM (SELECT vec FROM e WHERE vec_id = 0) a, (SELECT vec FROM e WHERE vec_id = 1) b, (SELECT vec FROM e WHERE vec_id = 2) c) SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(e.vec, q.vec), 9) DESC, vec_id) AS rank FROM e, q WHERE vec_id <> -1 QUALIFY rank <= 10")
def vec_analogy(spark, d):
    e = emb(spark, d)
    three = e.filter("vec_id IN (0, 1, 2)").select(F.lit(-1).cast("long").alias("qid"), "vec_id", "vec").groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("vec_id", "vec"))).alias("m"))
    at = lambda k: F.col("m")[F.lit(k).cast("long")]
    q = three.select("qid", v.combine(v.combine(at(1), at(0), 1.0, -1.0), at(2)).alias("vec"))
    return ml.nearest(e.select(F.col("vec_id").alias("id"), "vec"), q).select("id", "rank")


@query(f"WITH {_E}, x AS (SELECT vec_id AS id, label, generate_subscripts(vec, 1) AS i, unnest(vec) AS value FROM e), c AS (SELECT label, i, avg(value) AS value FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(value * value)) AS norm FROM c GROUP BY label), o AS (SELECT id, sqrt(sum(value * value)) AS own FROM x GROUP BY id), s AS (SELECT id, c.label, sum(x.value * c.value) / any_value(norm) / any_value(own) AS cosine FROM x JOIN c USING (i) JOIN n ON n.label = c.label JOIN o USING (id) GROUP BY ALL) SELECT id, label AS predicted, round(cosine, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, label) = 1")
def ml_centroid_classifier(spark, d):
    x = emb(spark, d).select(F.col("vec_id").alias("id"), "label", F.posexplode("vec").alias("i", "value"))
    return ml.centroid_classify(x, ml.centroids(x)).withColumn("cosine", r6("cosine"))


@query(f"WITH {TF}, l AS (SELECT doc_id, quality AS label FROM labels), s AS (SELECT tf.doc_id, term, label FROM tf JOIN l USING (doc_id)), d AS (SELECT term, count(*) AS df FROM s GROUP BY term HAVING count(*) >= 10), z AS (SELECT label, count(*) AS nl FROM l GROUP BY label), a AS (SELECT term, label, count(*) AS a FROM s GROUP BY ALL), t AS (SELECT z.label, d.term, CAST(coalesce(a.a, 0) AS DOUBLE) AS a, df, nl, (SELECT count(*) FROM l) AS n FROM d CROSS JOIN z LEFT JOIN a ON a.term = d.term AND a.label = z.label) SELECT label, term, round(CASE WHEN df * nl * (n - df) * (n - nl) > 0 THEN n * power(a * (n - df - nl + a) - (df - a) * (nl - a), 2) / (CAST(df AS DOUBLE) * (n - df) * nl * (n - nl)) ELSE 0 END, 6) AS chi2 FROM t")
def ml_chi_square(spark, d):
    vectors = c.doc_vectors(c.tokens(table(spark, d, "documents")))
    return ml.chi_square_features(vectors, table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))).withColumn("chi2", r6("chi2"))


@query(f"WITH {_E}, x AS (SELECT vec_id AS id, label, generate_subscripts(vec, 1) AS i, unnest(vec) AS value FROM e), c AS (SELECT label, i, avg(value) AS value FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(value * value)) AS norm FROM c GROUP BY label), s AS (SELECT id, c.label, sum(x.value * c.value) / any_value(norm) AS cosine FROM x JOIN c USING (i) JOIN n ON n.label = c.label GROUP BY ALL), p AS (SELECT id, label AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, label) = 1), k AS (SELECT CAST(e.label AS VARCHAR) AS label, CAST(predicted AS VARCHAR) AS predicted FROM p JOIN e ON e.vec_id = p.id), r AS (SELECT l AS label, count_if(label = l AND predicted = l) AS tp, count_if(predicted = l) AS pp, count_if(label = l) AS p FROM k, (SELECT DISTINCT label AS l FROM k) GROUP BY l), u AS (SELECT * FROM r UNION ALL SELECT 'all', CAST(sum(tp) AS BIGINT), CAST(sum(pp) AS BIGINT), CAST(sum(p) AS BIGINT) FROM r) SELECT label, CAST(tp AS BIGINT) AS tp, CAST(pp AS BIGINT) AS pp, CAST(p AS BIGINT) AS p, round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 6) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (pp + p) ELSE 0 END, 6) AS f1 FROM u")
def ml_classification_report(spark, d):
    p = ml_centroid_classifier(spark, d).select("id", F.col("predicted").cast("string").alias("predicted"))
    rows = emb(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label")).join(p, "id")
    out = ml.confusion(rows.select("label", "predicted"))
    return out.select("label", "tp", "pp", "p", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), n AS (SELECT coalesce(prev, '<s>') AS prev, role AS tag, count(*) AS n FROM s GROUP BY ALL) SELECT prev, tag, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS p FROM n")
def ml_tag_transitions(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("tag"))
    return ml.transitions(s).withColumn("p", r6("p"))


@query()
def ml_k_means(spark, d):
    """Rows only: the library's k-means starts by chance; a test checks what its clusters are worth."""
    return ml.k_means(emb(spark, d).select(F.col("vec_id").alias("id"), "vec"), 8)


@query()
def ml_agglomerative(spark, d):
    """Average linkage over all vectors; held against a plain version in tests."""
    return ml.agglomerate_all(emb(spark, d).select(F.col("vec_id").alias("id"), "vec"))


@query()
def ml_word_vectors(spark, d):
    """Skip-gram vectors of frequent words, on the library's trainer: rows only."""
    model = ml.word_vectors(table(spark, d, "documents"))
    return model.getVectors().select("word")


@query("WITH p AS (SELECT p_type AS term, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY p_type), g AS (SELECT term, ids, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i = 1 THEN ids[1] ELSE ids[i] - ids[i - 1] END) AS gaps FROM p) SELECT term, len(ids) AS n, array_to_string(gaps, ',') AS gaps, true AS same FROM g")
def codec_postings(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    g = p.withColumn("gaps", codecs.gap_encode(F.col("ids")))
    g = g.withColumn("read", codecs.decoded(codecs.encoded(F.col("gaps"))))
    back = codecs.gap_decode(F.col("read"))
    return g.select("term", F.size("ids").cast("long").alias("n"), F.array_join("gaps", ",").alias("gaps"), (back == F.col("ids")).alias("same"))


@query("SELECT l_returnflag AS i, r.l_returnflag AS j, round(sum(l.v * r.v), 2) AS v FROM (SELECT l_returnflag, l_shipdate, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) l JOIN (SELECT l_returnflag, l_shipdate, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) r USING (l_shipdate) GROUP BY ALL".replace("SELECT l_returnflag AS i", "SELECT l.l_returnflag AS i", 1))
def vec_matrix_product(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.sum("l_quantity").alias("v"))
    left = m.select(F.col("l_returnflag").alias("i"), "l_shipdate", F.col("v").alias("a"))
    right = m.select(F.col("l_returnflag").alias("j"), "l_shipdate", F.col("v").alias("b"))
    return left.join(right, "l_shipdate").groupBy("i", "j").agg(F.round(F.sum(F.col("a") * F.col("b")), 2).alias("v"))


@query("SELECT p_partkey AS id, round(lgamma(p_size + 0.5), 6) AS log_gamma, round(exp(-power((p_retailprice - 1000) / 100, 2) / 2) / (100 * sqrt(2 * pi())), 9) AS density, round(44 * power(p_size, 0.5), 6) AS heaps, round(1000 / power(p_size, 1.0), 6) AS zipf FROM part WHERE p_size > 0")
def vec_math(spark, d):
    p = table(spark, d, "part").filter("p_size > 0")
    size = F.col("p_size").cast("double")
    return p.select(F.col("p_partkey").alias("id"), r6(v.log_gamma(size + 0.5)).alias("log_gamma"), F.round(v.gaussian(F.col("p_retailprice"), 1000.0, 100.0), 9).alias("density"), r6(v.heaps(size, 44.0, 0.5)).alias("heaps"), r6(v.zipf(size, F.lit(1000.0))).alias("zipf"))


@query("SELECT p_brand, p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def vec_z_scores(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_brand", "p_partkey", r6((F.col("p_retailprice") - F.avg("p_retailprice").over(w)) / F.stddev_samp("p_retailprice").over(w)).alias("z"))
