"""Readers and writers on small files."""

from __future__ import annotations

import gzip

from textloom.sources import readers


def put(folder, name: str, text: str) -> str:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(path)


def tuples(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def test_lines_of_folders_and_compressed_files(spark, tmp_path):
    put(tmp_path, "a.txt", "x\ny\n")
    put(tmp_path, "b/c.gz", "é\n")
    assert tuples(readers.lines(spark, str(tmp_path))) == [("x",), ("y",), ("é",)]
    assert sorted(r["n"] for r in readers.line_counts(spark, str(tmp_path)).collect()) == [1, 2]


def test_whole_files_and_blocks(spark, tmp_path):
    path = put(tmp_path, "a.txt", "one\ntwo\n\n\nthree\n")
    assert readers.whole_files(spark, path).first()["value"] == "one\ntwo\n\n\nthree\n"
    assert tuples(readers.blocks(spark, path)) == [("one\ntwo",), ("three",)]


def test_separated_values(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "a\t1\nb\tx\n")
    rows = {r["k"]: (r["v"], r["_bad"]) for r in readers.tsv(spark, path, "k STRING, v INT").collect()}
    assert rows["a"] == (1, None) and rows["b"] == (None, "b\tx")


def test_counters(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 2.0)], "key string, value double")
    for by_key, order in ((True, "abc"), (False, "bca")):
        readers.write_counter(rows.repartition(3), str(tmp_path / "c"), by_key)
        parts = sorted((tmp_path / "c").glob("part-*"))
        assert [line.split("\t")[0] for p in parts for line in p.read_text().splitlines()] == list(order)
    assert tuples(readers.counter(spark, put(tmp_path, "d.tsv", "a\t1\na\t2\nb\t1\n"))) == [("a", 3.0), ("b", 1.0)]
    assert tuples(readers.counter_map(spark, put(tmp_path, "e.tsv", "a\tx\t1\na\tx\t2\nb\tx\t1\n"))) == [("a", "x", 3.0), ("b", "x", 1.0)]


def test_written_lines_return(spark, tmp_path):
    readers.write_lines(spark.createDataFrame([("x y",), ("z",)], "value string"), str(tmp_path / "w"))
    assert tuples(readers.lines(spark, str(tmp_path / "w"))) == [("x y",), ("z",)]


def test_runs_and_judgements(spark, tmp_path):
    assert tuples(readers.run_file(spark, put(tmp_path, "run", "1 Q0 d1 1 2.5 x\n1 d2 0.5\n1 d2 0.5\n"))) == [("1", "d1", 2.5), ("1", "d2", 1.0)]
    path = put(tmp_path, "qrels", "# topic\n1 0 d1 2\n1 0 d2 RELEVANT\n1 0 d3 -1\n1 0 d4 NOT\n")
    assert tuples(readers.judgements(spark, path)) == [("1", "d1", 2), ("1", "d2", 1), ("1", "d3", -1), ("1", "d4", 0)]
    marks = spark.createDataFrame([("1", "a", 1, 1, None), ("1", "b", 1, 2, None), ("1", "c", None, None, None)], "qid string, doc_id string, j1 int, j2 int, j3 int")
    assert tuples(readers.agreed_judgements(marks)) == [("1", "a", 1)]


def test_records_of_key_lines(spark, tmp_path):
    path = put(tmp_path, "a", ".I 1\n.T\nPart.I of two\n.W\nLine one\nline two\n.I 2\n.T\nold\n.T\nnew\n")
    got = sorted((r["record"] for r in readers.key_line_records(spark, path).collect()), key=lambda m: m[".I"])
    assert got == [{".I": "1", ".T": "Part.I of two", ".W": "Line one\nline two"}, {".I": "2", ".T": "new"}]


def test_attribute_blocks_and_tagged_sentences(spark, tmp_path):
    path = put(tmp_path, "a", "id: 1\ntitle: a: b\n\nid: 2\n")
    assert sorted((r["record"] for r in readers.attribute_blocks(spark, path).collect()), key=lambda m: m["id"]) == [{"id": "1", "title": "a: b"}, {"id": "2"}]
    rows = readers.tagged_sentences(spark, put(tmp_path, "b", "나는 나/NP\n간다 가/VV\n\n응 응/IC\n")).collect()
    assert sorted((r["pos"], r["word"], r["tag"]) for r in rows) == [(0, "나는", "나/NP"), (0, "응", "응/IC"), (1, "간다", "가/VV")]


def test_sparse_rows_xml_and_json(spark, tmp_path):
    rows = readers.sparse_rows(spark, put(tmp_path, "s", "1 2:0.5 7:1\n-1 3:2\n"))
    assert tuples(rows.drop("row")) == [(-1.0, 3, 2.0), (1.0, 2, 0.5), (1.0, 7, 1.0)]
    xml = put(tmp_path, "x.xml", "<all><doc><id>1</id><t>a</t></doc><doc><id>2</id></doc></all>")
    assert tuples(readers.xml_records(spark, xml, "doc", "id INT, t STRING").na.fill("")) == [(1, "a"), (2, "")]
    assert tuples(readers.json_documents(spark, put(tmp_path, "j", '{"a": 1}\n{"a": 2}\n'))) == [(1,), (2,)]
