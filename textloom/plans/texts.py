"""Normalisation, pages, properties, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.plans.base import query, r6, table
from textloom.sources import readers
from textloom.streaming import text as st


@query("SELECT doc_id, regexp_replace(text, '(\\d+)', '<n>', 'g') AS marked, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced, regexp_replace(text, '([()\\[\\]{}<>])', ' \\1 ', 'g') AS bracketed FROM documents")
def text_normalize(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(x, r"(\d+)", "<n>").alias("marked"), t.normalize_spaces(x).alias("spaced"), t.separate_brackets(x).alias("bracketed"))


@query("SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(text, '\\d+[\\d,.]*'), regexp_extract_all(text, '\\d+[\\d,.]*')), lambda z: z[1] || coalesce('<nu' || length(z[2]) || '>', '')), '') AS marked FROM documents")
def text_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalize_numbers(F.col("text")).alias("marked"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[\\s[:punct:]]+'), lambda w: w <> '')) AS n_split, len(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s])')) AS n_tokens, len(list_filter(string_split_regex(lower(text), '\\n+'), lambda s: trim(s) <> '')) AS n_sentences FROM documents")
def text_tokenizers(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(t.split_punctuation(x)).cast("long").alias("n_split"), F.size(t.word_tokens(x)).cast("long").alias("n_tokens"), F.size(t.sentences(x)).cast("long").alias("n_sentences"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]), ' ') AS bigrams, array_to_string(list_transform(range(1, length(p_type) - 1), lambda i: substr(p_type, i, 3)), ' ') AS trigrams FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)")
def text_ngrams(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(t.ngrams(F.split("p_name", " "), 2), " ").alias("bigrams"), F.array_join(t.char_ngrams(F.col("p_type"), 3), " ").alias("trigrams"))


@query("SELECT c_custkey AS id, regexp_matches(c_mktsegment, '^[A-Z]*$') AS upper, regexp_matches(c_name, '^[a-z]*$') AS lower, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g') AS shape, lower(c_name) AS word, right(c_name, 3) AS suffix, left(c_name, 3) AS prefix FROM customer")
def text_token_features(spark, d):
    f = t.token_features(F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), t.is_upper(F.col("c_mktsegment")).alias("upper"), t.is_lower(F.col("c_name")).alias("lower"), f["shape"].alias("shape"), f["word"].alias("word"), f["suffix"].alias("suffix"), f["prefix"].alias("prefix"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS n_links, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def source_pages(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(readers.html_links(h)).cast("long").alias("n_links"), readers.html_title(h).alias("title"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h[1-6])\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&amp;', '&'), '&[a-zA-Z#0-9]+;', '', 'g'), chr(13), ''), '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')) AS text FROM pages")
def source_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_text(F.col("html")).alias("text"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM events, (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events) WHERE json_extract_string(props, '$.' || key) IS NOT NULL")
def source_json(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).filter("value IS NOT NULL")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ' ' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def source_conversations(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return x.select("conv_id", "turns", F.array_join(F.col("r.role"), " ").alias("roles"), "chars")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    return st.event_counts(table(spark, d, "events")).withColumn("total", r6("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    return st.sessions(table(spark, d, "events"))
