"""Readers and writers of text corpora, runs, judgements and records, on Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines of text files, also compressed ones and those in folders below."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    return rows.limit(limit) if limit is not None else rows


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records between blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.trim(F.regexp_replace("value", r"^\n+|\n+$", "")).alias("value")).filter("value <> ''")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"))


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Tab-separated attributes; rows that don't fit the schema go to ``_bad`` with nulls elsewhere."""
    return spark.read.csv(path, schema=f"{schema}, _bad STRING", sep="\t", header=header, quote="", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def counter(spark: SparkSession, path: str) -> DataFrame:
    """key, value; repeated keys are summed."""
    return spark.read.csv(path, sep="\t", schema="key STRING, value DOUBLE").groupBy("key").agg(F.sum("value").alias("value"))


def write_counter(rows: DataFrame, path: str, by_key: bool = False) -> None:
    rows.orderBy("key" if by_key else F.desc("value"), "key").write.mode("overwrite").csv(path, sep="\t")


def write_lines(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    rows.write.mode("overwrite").text(path, compression=compression)


def counter_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="outer STRING, inner STRING, value DOUBLE").groupBy("outer", "inner").agg(F.sum("value").alias("value"))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, score of a run; repeated documents are summed."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    six = F.size("f") >= 6
    return rows.select(F.col("f")[0].alias("qid"), F.when(six, F.col("f")[2]).otherwise(F.col("f")[1]).alias("doc_id"), F.when(six, F.col("f")[4]).otherwise(F.col("f")[2]).cast("double").alias("score")).groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))


def run_lines(scored: DataFrame, name: str, k: int = 1000) -> DataFrame:
    """Lines ``qid Q0 doc rank score name``; scores that agree to nine places are ties."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(name)).alias("value"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of space-delimited judgements; lines that start with # are comments."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(f.alias("f")).filter(F.size("f") >= 4).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.when(F.col("f")[3] == "RELEVANT", 1).otherwise(F.col("f")[3].try_cast("int")).alias("rel")).na.fill({"rel": 0})


def agreed_judgements(rows: DataFrame) -> DataFrame:
    """qid, doc_id, rel of rows with judges j1, j2, j3, where all that judged agree."""
    marks = F.filter(F.array("j1", "j2", "j3"), lambda j: j.isNotNull())
    return rows.withColumn("m", F.array_distinct(marks)).filter(F.size("m") == 1).select("qid", "doc_id", F.col("m")[0].alias("rel"))


def key_line_records(spark: SparkSession, path: str, start: str = ".I") -> DataFrame:
    """Records whose fields begin with lines such as ``.T``: a map from key to text, the last one of a repeated key.

    A record begins at a line that starts with ``start``; the same characters inside a line are text.
    """
    rows = spark.read.option("lineSep", f"\n{start} ").text(path).filter(F.trim("value") != "")
    rows = rows.select(F.when(F.startswith("value", F.lit(f"{start} ")), F.substring("value", len(start) + 2, 1 << 30)).otherwise(F.col("value")).alias("value"))
    parts = F.split(F.concat(F.lit(f"{start}\n"), F.col("value")), r"(?:^|\n)(?=\.[A-Z]\s*\n)")
    pairs = F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("k"), F.btrim(F.regexp_replace(p, r"^[^\n]*\n", ""), F.lit(" \t\n")).alias("v")))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), -1)["v"])
    return rows.select(pairs.alias("pairs")).select(F.map_from_arrays(keys, last).alias("record"))


def attribute_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of ``key: value`` lines as maps."""
    return blocks(spark, path).select(F.str_to_map("value", F.lit("\n"), F.lit(": ")).alias("record"))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    """seq, pos, word, tag of blank-line separated sentences of ``word tag`` lines."""
    rows = blocks(spark, path).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("seq", F.posexplode(F.split("value", "\n")).alias("pos", "line")).select("seq", "pos", F.split("line", r"\s+")[0].alias("word"), F.element_at(F.split("line", r"\s+"), -1).alias("tag"))


def sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """label and components of ``label i:value ...`` lines: row, label, i, value."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row"), f.alias("f"))
    return rows.select("row", F.col("f")[0].cast("double").alias("label"), F.explode(F.slice("f", 2, F.size("f") - 1)).alias("x")).select("row", "label", F.split("x", ":")[0].cast("int").alias("i"), F.split("x", ":")[1].cast("double").alias("value"))


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def json_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.json(path, multiLine=multi_line)


def tree_depths(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root, depth and path of a forest of (parent, child), level by level; a node on a cycle is under no root.

    Levels are checkpointed if there is a folder for it, so plans of deep trees stay short.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    level = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    out = level
    while True:
        level = level.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col("child").cast("string")).alias("path"))
        level = level.checkpoint() if folder else level.persist()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, blocks end lines, entities are decoded."""
    from textloom.functions.text import decode_entities

    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    x = F.replace(decode_entities(F.replace(x, F.lit("&nbsp;"), F.lit(" "))), F.lit("\r"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), 1)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
