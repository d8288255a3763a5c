"""String similarity and search over names."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import similarity as s
from textloom.operators import string_search as ss
from textloom.plans.base import query, r6, table


def pairs(spark, d):
    """Supplier names with customer names of the same nation, and neighbouring parts' names."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.lower("p_type").alias("b")), "id")


_P = "p AS (SELECT x.p_partkey AS id, lower(x.p_name) AS a, lower(y.p_type) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"
_DOT = "list_sum(list_transform(list_intersect(list_distinct(string_split({0}, '')), list_distinct(string_split({1}, ''))), lambda c: CAST((length({0}) - length(replace({0}, c, ''))) * (length({1}) - length(replace({1}, c, ''))) AS DOUBLE)))"
_AB, _AA, _BB = (f"coalesce({_DOT.format(x, y)}, 0)" for x, y in (("a", "b"), ("a", "a"), ("b", "b")))


@query(f"WITH {_P}, d AS (SELECT id, a, b, {_AB} AS ab, {_AA} AS aa, {_BB} AS bb FROM p) SELECT id, levenshtein(a, b) AS edit, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edit_sim, round(ab / sqrt(aa * bb), 6) AS cosine, round(2 * ab / (aa + bb), 6) AS dice, round(ab / (aa + bb - ab), 6) AS jaccard, round(sqrt(greatest(0, aa + bb - 2 * ab)), 6) AS euclid FROM d")
def strings_measures(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("id", F.levenshtein(a, b).cast("long").alias("edit"), r6(s.edit_similarity(a, b)).alias("edit_sim"), r6(s.char_cosine(a, b)).alias("cosine"), r6(s.char_dice(a, b)).alias("dice"), r6(s.char_jaccard(a, b)).alias("jaccard"), r6(s.char_euclidean(a, b)).alias("euclid"))


@query(f"WITH {_P} SELECT id, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) AS jaccard FROM p")
def strings_set_jaccard(spark, d):
    return pairs(spark, d).select("id", r6(s.set_jaccard(F.split("a", " "), F.split("b", " "))).alias("jaccard"))


@query()
def strings_alignments(spark, d):
    """Measures by dynamic programs; held against plain versions in tests."""
    return pairs(spark, d).select("id", *(r6(s.measure(f)("a", "b")).alias(n) for n, f in s.MEASURES.items()), s.measure(lambda a, b: s.align(a, b)[0], "string")("a", "b").alias("steps"))


@query(f"WITH {_P} SELECT id, CAST(damerau_levenshtein(a, b) AS DOUBLE) AS distance FROM p WHERE length(a) < 12")
def strings_damerau(spark, d):
    return pairs(spark, d).filter(F.length("a") < 12).select("id", s.measure(s.damerau_full)("a", "b").alias("distance"))


@query(f"WITH {_P} SELECT id, CAST(damerau_levenshtein(a, b) AS DOUBLE) AS distance FROM p")
def strings_damerau_all(spark, d):
    """The same for names of any length."""
    return pairs(spark, d).select("id", s.measure(s.damerau_full)("a", "b").alias("distance"))


_G = "g AS (SELECT id, length(text) AS n, i AS pos, substr(pad, i + 1, {q}) AS gram FROM (SELECT id, text, repeat(chr(2), {q} - 1) || text || repeat(chr(3), {q} - 1) AS pad FROM st), unnest(range(0, length(text) + {q} - 1)) t(i))"
_NAMES = "st AS (SELECT p_partkey AS id, lower(p_name) AS text FROM part)"


def names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text"))


@query(f"WITH {_NAMES}, {_G.format(q=3)} SELECT gram, count(*) AS n, count(DISTINCT id) AS df, round(ln(((SELECT count(*) FROM st) + 1) / count(DISTINCT id)), 6) AS idf FROM g GROUP BY gram")
def strings_gram_weights(spark, d):
    return ss.gram_weights(ss.grams(names(spark, d))).withColumn("idf", r6("idf"))


@query("WITH c AS (SELECT DISTINCT c_name AS text FROM customer), s AS (SELECT s_suppkey AS id, replace(s_name, 'Supplier', 'Customer') AS text FROM supplier) SELECT s.id AS left_id, c.c_custkey AS right_id, levenshtein(s.text, c.c_name) AS distance FROM s, customer c WHERE levenshtein(s.text, c.c_name) <= 1")
def strings_edit_join(spark, d):
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("text"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return ss.edit_join(left, right, tau=1, q=3).select("left_id", "right_id", F.col("distance").cast("long").alias("distance"))


_ASK = [(1, "red lavender"), (2, "green part"), (3, "blue metallic")]


@query(f"WITH {_NAMES}, qs(qid, text) AS (VALUES {', '.join(f'({i}, {t!r})' for i, t in _ASK)}), {_G.format(q=3)}, dg AS (SELECT DISTINCT id, gram FROM g), wt AS (SELECT gram, ln(((SELECT count(*) FROM st) + 1) / count(*)) AS idf FROM dg GROUP BY gram), qg AS (SELECT DISTINCT qid, substr(pad, i + 1, 3) AS gram FROM (SELECT qid, text, repeat(chr(2), 2) || text || repeat(chr(3), 2) AS pad FROM qs), unnest(range(0, length(text) + 2)) t(i)), ask AS (SELECT qid, gram, idf FROM qg JOIN wt USING (gram) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY idf DESC, gram) <= 6), f AS (SELECT qid, id, sum(idf) AS weight FROM dg JOIN ask USING (gram) GROUP BY ALL), sc AS (SELECT f.qid, f.id, weight, 1 - levenshtein(st.text, qs.text) / greatest(length(st.text), length(qs.text)) AS score FROM f JOIN st USING (id) JOIN qs USING (qid)) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, round(weight, 6) AS weight, round(score, 6) AS score FROM sc QUALIFY rank <= 10")
def strings_search(spark, d):
    found = ss.search(names(spark, d), spark.createDataFrame(_ASK, "qid int, text string"))
    return found.withColumn("weight", r6("weight")).withColumn("score", r6("score"))


@query("WITH k AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] AS key FROM part) SELECT lower(p_name) AS word, arg_max(key, length(key)) AS longest FROM part JOIN k ON starts_with(lower(p_name), key) GROUP BY 1")
def strings_longest_prefix(spark, d):
    n = names(spark, d)
    return ss.longest_prefix(n.select(F.split("text", " ")[0].alias("key")), n.select(F.col("text").alias("word")).distinct())


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'part') AND regexp_matches(p_name, '1.*')")
def strings_prefix_and_wildcard(spark, d):
    return table(spark, d, "part").filter(F.startswith(F.lower("p_name"), F.lit("part")) & F.col("p_name").rlike("1.*")).select("p_partkey", "p_name")


@query("SELECT p_partkey AS id, array_to_string([substr(p_name, 1, cut), substr(p_name, cut + 1, cut), substr(p_name, 2 * cut + 1)], '|') AS parts FROM (SELECT *, CAST(floor(length(p_name) / 3) AS INT) AS cut FROM part)")
def strings_even_partition(spark, d):
    cut = F.floor(F.length("p_name") / 3).cast("int")
    p = table(spark, d, "part").withColumn("cut", cut)
    one = F.lit(1)
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws("|", F.substr("p_name", one, F.col("cut")), F.substr("p_name", F.col("cut") + 1, F.col("cut")), F.substr("p_name", 2 * F.col("cut") + 1)).alias("parts"))
