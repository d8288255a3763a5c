"""Models of words from feedback documents, expansion by variants, segmentation of phrases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import corpus as c
from textloom.operators import feedback as f
from textloom.operators import retrieval as r
from textloom.operators.shards import kept
from textloom.plans.base import WORDS, query, r6, table, topics
from textloom.plans.retrieval import _DIR, _KLD, _M, _TOP, best_documents, index, whole_index

_RANKED = f"{_M}, s AS ({_KLD.format(p=_DIR)}), rk AS (SELECT *, {_TOP} FROM s), top AS (SELECT * FROM rk WHERE rank <= 10)"
_BG = "(SELECT term, cf / n_tokens AS near, cf / n_tokens AS far FROM vocab, cs)"


def _smoothed(out: str, ranked: str, by: str = "qid", levels: str = _BG, on: str = "term") -> str:
    seen = f"(SELECT {by}, term, sum(score * tf / (dl + 2000.0)) AS seen FROM {ranked} JOIN tf USING (doc_id) JOIN dl USING (doc_id) GROUP BY ALL)"
    mass = f"(SELECT {by}, sum(score) AS total, sum(score * 2000.0 / (dl + 2000.0)) AS held FROM {ranked} JOIN dl USING (doc_id) GROUP BY ALL)"
    return f"{out} AS (SELECT {by}, term, 0.5 * (seen + held * near) + 0.5 * total * far AS p FROM {seen} JOIN {mass} USING ({by}) JOIN {levels} USING ({on}))"


def _best(out: str, words: str) -> str:
    return f"{out} AS (SELECT qid, term, p / sum(p) OVER (PARTITION BY qid) AS p FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, term) AS r FROM {words}) WHERE r <= 30)"


_OUT = "SELECT qid, term, round(p, 6) AS p FROM "


def model(df):
    return df.select("qid", "term", r6("p").alias("p"))


def kld(spark, d, k: int = 10):
    """The first documents of each query by divergence: an index about them, their ranking, and the documents."""
    i = index(spark, d)
    best, some = best_documents(spark, d, r.language_model(i, topics(spark)), k)
    return i.about(table(spark, d, "documents"), some), best, some


@query(f"{_RANKED}, later AS (SELECT * FROM rk WHERE rank BETWEEN 101 AND 110), {_smoothed('wa', 'top')}, {_best('a', 'wa')}, {_smoothed('wb', 'later')}, {_best('b', 'wb')}, n AS (SELECT qid, term, exp(10 * sum(p)) AS p FROM (SELECT * FROM a UNION ALL SELECT qid, term, -p FROM b) GROUP BY ALL), {_best('o', 'n')} {_OUT} o")
def ir_negative_model(spark, d):
    return model(f.negative_model(*kld(spark, d, 110)[:2]))


def _passages(weight: str) -> str:
    pt = "pt AS (SELECT qid, doc_id, score, CAST(floor(pos / 500) AS BIGINT) AS passage, term, count(*) AS tf FROM tokens JOIN top USING (doc_id) GROUP BY ALL), pl AS (SELECT qid, doc_id, score, passage, sum(tf) AS pl FROM pt GROUP BY ALL)"
    e = "e AS (SELECT pl.qid, pl.doc_id, pl.passage, any_value(pl.score) AS score, any_value(pl.pl) AS pl, exp(-sum(q.qtf / ql.ql * ln((q.qtf / ql.ql) / (0.5 * coalesce(pt.tf, 0) / pl.pl + 0.5 * v.cf / n_tokens)))) AS w0 FROM pl JOIN q ON q.qid = pl.qid JOIN ql ON ql.qid = pl.qid JOIN vocab v ON v.term = q.term LEFT JOIN pt ON pt.qid = pl.qid AND pt.doc_id = pl.doc_id AND pt.passage = pl.passage AND pt.term = q.term, cs GROUP BY ALL)"
    ch = f"ch AS (SELECT qid, doc_id, passage, pl, score * w AS w FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(w, 12) DESC, passage) AS r FROM (SELECT *, {weight} AS w FROM e)) WHERE r <= 10)"
    sn = "sn AS (SELECT qid, term, sum(w * tf / ch.pl) AS seen FROM pt JOIN ch USING (qid, doc_id, passage) GROUP BY ALL)"
    words = "pw AS (SELECT qid, term, 0.5 * coalesce(seen, 0) + 0.5 * total * cf / n_tokens AS p FROM (SELECT DISTINCT qid, term FROM top JOIN tf USING (doc_id)) LEFT JOIN sn USING (qid, term) JOIN (SELECT qid, sum(w) AS total FROM ch GROUP BY qid) USING (qid) JOIN vocab USING (term), cs)"
    return f"{_RANKED}, {pt}, {e}, {ch}, {sn}, {words}, {_best('o', 'pw')} {_OUT} o"


def _passage_model(spark, d, by_place: bool):
    i, best, some = kld(spark, d)
    return model(f.passage_model(i, c.tokens(some), topics(spark), best, by_place=by_place))


@query(_passages("w0 * exp(-passage) / sum(w0 * exp(-passage)) OVER (PARTITION BY qid, doc_id)"))
def ir_passage_model(spark, d):
    return _passage_model(spark, d, True)


@query(_passages("w0"))
def ir_passage_model_by_score(spark, d):
    return _passage_model(spark, d, False)


@query(f"{_RANKED}, w AS (SELECT qid, term, sum(tf / dl) AS s, sum(power(tf / dl, 2)) AS s2 FROM top JOIN tf USING (doc_id) JOIN dl USING (doc_id) GROUP BY ALL), sp AS (SELECT qid, term, s * (n - 1) - s * s + s2 AS p FROM w JOIN (SELECT qid, count(*) AS n FROM top GROUP BY qid) USING (qid)), {_best('o', 'sp')} {_OUT} o")
def ir_specific_model(spark, d):
    return model(f.specific_model(*kld(spark, d)[:2]))


_BY_COLLECTION = "(SELECT collection, term, k.cf / n AS near, v.cf / n_tokens AS far FROM (SELECT *, sum(cf) OVER (PARTITION BY collection) AS n FROM (SELECT coalesce(lang, '') AS collection, term, sum(tf) AS cf FROM tf JOIN documents USING (doc_id) GROUP BY ALL)) k JOIN vocab v USING (term), cs)"


@query(f"{_M}, s AS ({_KLD.format(p=_DIR)}), top AS (SELECT qid, collection, doc_id, score FROM (SELECT s.*, coalesce(lang, '') AS collection, row_number() OVER (PARTITION BY qid, coalesce(lang, '') ORDER BY round(score, 9) DESC, doc_id) AS r FROM s JOIN documents USING (doc_id)) WHERE r <= 10), {_smoothed('cw', 'top', 'qid, collection', _BY_COLLECTION, 'collection, term')}, sh AS (SELECT qid, collection, sum(score) / sum(sum(score)) OVER (PARTITION BY qid) AS share FROM top GROUP BY qid, collection), mx AS (SELECT qid, term, sum(share * p) AS p FROM cw JOIN sh USING (qid, collection) GROUP BY ALL), {_best('o', 'mx')} {_OUT} o")
def ir_cluster_expansion(spark, d):
    i = index(spark, d)
    collections = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("collection"))
    w = Window.partitionBy("qid", "collection").orderBy(F.desc(F.round("score", 9)), "doc_id")
    scored = r.language_model(i, topics(spark)).join(collections, "doc_id")
    best = kept(scored.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("qid", "collection", "doc_id", "score"), "ranking")
    docs = table(spark, d, "documents")
    ids = [x.doc_id for x in best.select("doc_id").distinct().collect()]  # 10 a query and language
    about = i.about(docs, docs.filter(F.col("doc_id").isin(ids)))
    by = docs.select(F.coalesce("lang", F.lit("")).alias("collection"), "text")
    counts = kept(c.term_counts(by, about.vectors.select("term").distinct(), ("collection",)), "counts")
    about.vocab = counts.groupBy("term").agg(F.sum("cf").alias("cf"))
    return model(f.cluster_expansion(about, best, collections, counts=counts))


_SENTS = "sl AS (SELECT doc_id, generate_subscripts(x, 1) AS sent_id, unnest(x) AS line FROM (SELECT doc_id, string_split_regex(lower(text), '\\n+') AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM top))), sw AS (SELECT doc_id, sent_id, list_filter(string_split_regex(line, '\\s+'), lambda t: t <> '') AS w FROM sl), st AS (SELECT doc_id, sent_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM sw)"
_NEAR = "pa AS (SELECT a.doc_id, a.term AS l, b.term AS r, 1.0 / (b.pos - a.pos) AS x FROM st a JOIN st b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos > a.pos AND b.pos <= a.pos + 5), nr AS (SELECT doc_id, l, r, sum(x) AS x FROM (SELECT * FROM pa UNION ALL SELECT doc_id, r, l, x FROM pa WHERE l <> r) GROUP BY ALL)"
_MOVED = "pd AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS p FROM tf WHERE doc_id IN (SELECT doc_id FROM top)), gt AS (SELECT doc_id, l AS term, sum(share * p) AS p FROM (SELECT doc_id, l, r AS term, x / sum(x) OVER (PARTITION BY doc_id, r) AS share FROM nr) JOIN pd USING (doc_id, term) GROUP BY ALL), tr AS (SELECT pd.doc_id, pd.term, coalesce(gt.p, 0) AS p FROM pd LEFT JOIN gt USING (doc_id, term))"


@query(f"{_RANKED}, {_SENTS}, {_NEAR}, {_MOVED}, tw AS (SELECT qid, term, 0.5 * seen + 0.5 * total * cf / n_tokens AS p FROM (SELECT qid, term, sum(score * p) AS seen FROM top JOIN tr USING (doc_id) GROUP BY ALL) JOIN (SELECT qid, sum(score) AS total FROM top GROUP BY qid) USING (qid) JOIN vocab USING (term), cs), {_best('o', 'tw')} {_OUT} o")
def ir_translated_model(spark, d):
    i, best, some = kld(spark, d)
    return model(f.translated_model(i, c.sentence_tokens(some), best))


@query(f"{_M}, qm AS (SELECT qid, term, sum(qtf) / any_value(ql) AS p FROM q JOIN ql USING (qid) GROUP BY qid, term), vr AS (SELECT qm.qid, v.term, count(*) AS n FROM qm, vocab v WHERE v.term IN (qm.term || 's', qm.term || 'n', qm.term || 'r') GROUP BY ALL) SELECT qid, term, round(sum(p), 6) AS p FROM (SELECT qid, term, 0.9 * p AS p FROM qm UNION ALL SELECT qid, term, 0.1 * n / sum(n) OVER (PARTITION BY qid) FROM vr) GROUP BY ALL")
def ir_variant_expansion(spark, d):
    """Variants are words of the vocabulary that add one of three letters."""
    of = F.expr("left(term, length(term) - 1)")
    known = whole_index(spark, d).vocab.filter(F.col("term").rlike("[snr]$")).select(of.alias("term"), F.col("term").alias("variant"))
    return model(f.with_variants(r.query_model(topics(spark)), known))


@query(f"WITH {WORDS}, ph AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS phrase FROM words WHERE len(w) >= 3 AND NOT list_contains(w[1:3], '</s>')), g AS (SELECT DISTINCT doc_id, part FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS part FROM words)), n AS (SELECT part, count(*) AS n FROM g GROUP BY part), ct AS (SELECT phrase, CAST(cut AS INT) AS cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS l, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS r FROM ph, range(1, 3) x(cut)) SELECT phrase, cut, a.n AS n_left, b.n AS n_right, o.n AS n_both, round(CASE WHEN o.n = nd THEN 1 ELSE ln(o.n * nd / (a.n * b.n)) / -ln(o.n / nd) END, 6) AS npmi FROM ct JOIN n a ON a.part = l JOIN n b ON b.part = r JOIN n o ON o.part = phrase, (SELECT count(*) AS nd FROM documents)")
def mine_segmentations(spark, d):
    """The phrases are the first three words of every document whose first line has as many."""
    docs = table(spark, d, "documents")
    first = F.slice(t.tokens_with_breaks(F.col("text")), 1, 3)
    phrases = docs.select(first.alias("w")).filter((F.size("w") == 3) & ~F.array_contains("w", t.BREAK)).select(F.array_join("w", " ").alias("phrase"))
    return f.segmentations(docs, phrases, 3).withColumn("npmi", r6("npmi"))
