import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.plans import pipelines
from docloom.sources import files, ocr, sinks
from docloom.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "sub").mkdir()
    (d / "a.txt").write_text("one\n\n two \n \nthree")
    (d / "b.md").write_text("# T\n\n| x |\n|--|\n| 1 |\n")
    (d / "sub" / "c.html").write_text(
        "<html><body><h2>H &amp; I</h2><p>one<br>two<li><p>in</p></li>"
        "<table><tr><th>a</th></tr><tr><td><p>b</p></td></tr><tr><td> </td></tr></table><script>no</script></body></html>"
    )
    (d / "d.csv").write_text('h,"a\nb"\n\n"x,y",2\n')
    (d / "e.csv").write_text("")
    (d / "skip.bin").write_text("?")
    (d / "bad.docx").write_text("not a zip")
    with zipfile.ZipFile(d / "g.docx", "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>'
            "<w:p><w:r><w:t>body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p/>"
            "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>",
        )
    return str(d)


def test_folder(spark, folder):
    names = {r.doc_id: r.path.rpartition("/")[2] for r in files.scan(spark, folder).collect()}
    assert sorted(names.values()) == ["a.txt", "b.md", "bad.docx", "c.html", "d.csv", "g.docx"]  # Spark lists no empty file
    got = {}
    for r in files.read_folder(spark, folder).orderBy("pos").collect():
        got.setdefault(names[r.doc_id], []).append((r.type, r.text, r.level, r.table) if r._error is None else r._error)
    assert got["a.txt"] == [("paragraph", t, None, None) for t in ("one", "two", "three")]
    assert got["b.md"] == [("heading", "T", 1, None), ("table", "", None, "| x |\n| --- |\n| 1 |")]
    assert got["d.csv"] == [("table", "", None, "**Table: d.csv**\n\n| h | a\nb |\n| --- | --- |\n| x,y | 2 |")]
    assert files.csv_elements("", "e.csv") == [("table", "", None, "")]
    assert got["g.docx"] == [("heading", "Top", 2, None), ("paragraph", "body text", None, None), ("table", "", None, "| k |\n| --- |")]
    assert len(got["bad.docx"]) == 1 and "BadZipFile" in got["bad.docx"][0]
    kinds = [x[:2] for x in got["c.html"]]
    assert kinds[0] == ("heading", "H & I") and ("list_item", "in") in kinds and kinds.count(("paragraph", "in")) == 1
    assert ("paragraph", "b") in kinds and [x[3] for x in got["c.html"] if x[0] == "table"] == ["| a |\n| --- |\n| b |"]
    chunks = pipelines.ingest(spark, folder).collect()
    assert chunks and all(len(c.vector) == 384 for c in chunks)


def test_unknown_format_is_an_error(spark):
    df = spark.createDataFrame([("x.odd",)], "p string").select(files.format_of(F.col("p")))
    with pytest.raises(Exception, match="unknown format"):
        df.collect()


def test_ocr_text(spark):
    rows = [
        (1, 1, 1, "good"), (1, 2, 1, "x"), (1, 3, 2, "ab"), (2, 4, 1, "قل"), (2, 5, 3, "line"), (3, 6, 4, "***"), (3, 7, 5, "line"), (4, 8, 6, " "),
    ]
    conf = ["90", "5", "bad", "3", "80", "90", "80", "90"]
    df = spark.createDataFrame(
        [(1, 1, 0, 0, ln, w, t, c) for (ln, w, _, t), c in zip(rows, conf)],
        "doc_id int, page int, block_num int, par_num int, line_num int, word_num int, text string, conf string",
    )
    assert ocr.page_text(df).first().text == "good\nقل line\n*** line"
    s = ocr.page_stats(df).first()
    assert (s.low_count, s.token_count) == (2, 6) and s.mean_conf == pytest.approx((90 + 5 + 3 + 80 + 90 + 80) / 6, abs=1e-5)


def test_ocr_cleaning(spark):
    df = spark.createDataFrame([("﻿a  b\n\n\n\nc‏", "x\n---\nx\n\n\nx\ny")], "n string, r string")
    got = df.select(ocr.normalize(F.col("n")).alias("n"), ocr.remove_noise(F.col("r")).alias("r")).first()
    assert (got.n, got.r) == ("a b\n\nc", "x\n\ny")


@pytest.mark.parametrize("text,conf,n,want", [("", 90.0, 5, True), ("a" * 30, 90.0, 0, True), ("a" * 19, 90.0, 5, True), ("1" * 30, 90.0, 5, True), ("a" * 30, 17.0, 5, True), ("ب" * 30, 17.0, 5, False), ("a" * 30, 18.0, 5, False)])
def test_weak_pages(spark, text, conf, n, want):
    df = spark.createDataFrame([(text, conf, n, "native text")], "text string, mean_conf double, token_count int, native string")
    assert df.select(ocr.is_weak(F.col("text"), F.col("mean_conf"), F.col("token_count")).alias("w")).first().w == want
    assert (ocr.best_text(df).first().text == "native text") == (want and len(text) < 11)


def test_table_geometry(spark):
    box = "array<struct<x0:double,top:double,x1:double,bottom:double>>"
    df = spark.createDataFrame([([(0.0, 0.0, 10.0, 5.0), (5.0, 5.0, 1.0, 9.0)], 10.0, 10.0)], f"b {box}, w double, h double")
    assert df.select(ocr.table_area_ratio(F.col("b"), F.col("w"), F.col("h")).alias("r")).first().r == 0.5
    cells = spark.createDataFrame([(1, 1, 1, 5.0, 13.0, "b2"), (1, 1, 1, 0.0, 10.0, "b1"), (1, 1, 1, 0.0, 2.0, "a1"), (1, 1, 1, 9.0, 5.0, "a2")], "doc_id int, page int, table_no int, x0 double, top double, text string")
    got = sorted((r.row, r.col, r.text) for r in ocr.cell_rows(cells).collect())
    assert got == [(0, 0, "a1"), (0, 1, "a2"), (1, 0, "b1"), (1, 1, "b2")]


def test_stores_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", [1.0, 2.0])], "chunk_id string, vector array<double>")
    sinks.add(df, str(tmp_path / "s"), 2)
    sinks.add(df, str(tmp_path / "s"), 2)
    assert sinks.load(spark, str(tmp_path / "s")).count() == 2
    with pytest.raises(Exception, match="must have 3"):
        sinks.add(df, str(tmp_path / "s"), 3)
    rows = spark.createDataFrame([("q", "r", ["a", "b"], 1.0, 0.5, 0.2, None, 0.1, 2.0)], "id string, route string, techniques array<string>, context_relevance double, faithfulness double, answer_relevance double, correctness double, total_cost double, latency double")
    sinks.save_csv(rows, str(tmp_path / "c"))
    sinks.save_json(rows, str(tmp_path / "j"))
    back = spark.read.csv(str(tmp_path / "c"), header=True).first()
    assert back.techniques == "a,b" and back.correctness is None and spark.read.json(str(tmp_path / "j")).count() == 1


def test_streaming_ingest_appends_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"stock item {i} " * 20) for i in range(5)], "doc_id long, text string")
    rows.filter("doc_id < 3").write.parquet(src)
    ingest.ingest(spark, src, rows.schema, store, 100, 10).awaitTermination()
    first = ingest.chunks(spark, store).count()
    rows.filter("doc_id >= 3").write.mode("append").parquet(src)
    ingest.ingest(spark, src, rows.schema, store, 100, 10).awaitTermination()
    assert first > 0 and ingest.chunks(spark, store).select("doc_id").distinct().count() == 5
    assert ingest.postings(spark, store).filter("term = 'stock'").select("chunk_id").distinct().count() == ingest.chunks(spark, store).count()


def test_bad_bytes_pdfs_and_deep_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.html").write_text("<p>x" * 3000)
    rows = files.read_folder(spark, str(tmp_path)).collect()
    assert [r.text for r in rows if r.type == "paragraph" and r.text.startswith("good")] == ["good \ufffd text"]
    assert [r["_error"] for r in rows if r["_error"]] == ["no extractor for PDF"]
    assert sum(r.type == "paragraph" for r in rows) == 3001
