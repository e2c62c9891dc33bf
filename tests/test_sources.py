"""Files, HTML, CSV, recognised words, sinks and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumine import sinks
from vellumine.sources import files, structured
from vellumine.sources import lines as line_source
from vellumine.streaming import records as streaming

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>EXPERIENCE</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Item</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Cell B</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
)


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{BODY}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="https://a.example/x"/></Relationships>')
    return out.getvalue()


def test_docx_files(spark, tmp_path):
    folder = tmp_path / "cat"
    folder.mkdir()
    (folder / "one.docx").write_bytes(docx())
    (folder / "bad.docx").write_bytes(b"PK not a zip")
    (folder / "old.doc").write_bytes(b"\xd0\xcf")
    (folder / "two.pdf").write_bytes(b"%PDF-1.4")
    found = files.with_status(files.files(spark, str(tmp_path)))
    assert {r.filename: (r.kind, r.status, r.category) for r in found.collect()} == {"one.docx": ("docx", "ok", "cat"), "bad.docx": ("docx", "ok", "cat"), "old.doc": ("unsupported", "unsupported", "cat"), "two.pdf": ("pdf", "ok", "cat")}
    lines, links, broken = files.docx_documents(found.filter("kind = 'docx'"))
    rows = lines.orderBy("line_ord").collect()
    assert [r.text for r in rows] == ["EXPERIENCE", "• Item", "site", "Cell A\tCell B"] and rows[0].spans[0].bold and rows[0].spans[0].size == 14.0
    assert links.first().uri == "https://a.example/x" and broken.count() == 1
    assert files.with_status(files.files(spark, str(tmp_path)), most_bytes=5).filter("status = 'too_large'").count() == 3
    with pytest.raises(NotImplementedError):
        files.engine("none")


def test_page_gate_and_recognised_lines(spark):
    lines = spark.createDataFrame([("d", 0, 0, "(cid:1)(cid:2) x"), ("d", 1, 0, "A page with quite enough readable text on it.")], "doc_id string, page_no int, line_ord int, text string")
    gate = line_source.page_gate(lines)
    assert {r.page_no: r.needs_ocr for r in gate.collect()} == {0: True, 1: False}
    words = spark.createDataFrame([("d", 0, 1, 1, 1, 0, "Read", 90.0, 100.0, 100.0, 50.0, 20.0), ("d", 0, 1, 1, 1, 1, "text", 80.0, 160.0, 100.0, 50.0, 20.0), ("d", 0, 1, 1, 2, 0, "|", -1.0, 0.0, 0.0, 1.0, 1.0)],
                                  "doc_id string, page_no int, block int, par int, line int, word int, text string, conf double, left double, top double, width double, height double")
    read = line_source.recognised_lines(words)
    assert read.first().text == "Read text" and read.first().bbox.x0 == 24.0
    whole = line_source.replaced_pages(lines, gate, read.select("doc_id", "page_no", "line_ord", "text")).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in whole] == [(0, "Read text"), (1, "A page with quite enough readable text on it.")]


def test_labelled_html(spark):
    html = ('<div class="sectiontitle">Work &amp; more</div><div id="SECTION_EXPR1"><div class="paragraph first"><span itemprop="JTIT">Clerk</span><span itemprop="COMP">Company Name</span><ul><li>Did <b>this</b></li></ul></div>'
            '<div class="paragraph"><span itemprop="JTIT">Head Clerk</span></div></div><div id="SECTION_XXXX9"><div class="paragraph">x</div></div>')
    p = spark.createDataFrame([(1, html)], "id int, html string")
    got = structured.coded_entries(p, "id", "html").orderBy("chunk").collect()
    assert [(r.section, r.fields, r.bullets) for r in got] == [("workHistory", {"title": "Clerk"}, ["Did this"]), ("workHistory", {"title": "Head Clerk"}, [])]
    assert structured.section_titles(p, "id", "html").first().title == "Work & more"


def test_csv_with_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("names,years\n\"['A b', 'N/A']\",\"['1', None]\"\n")
    rows = structured.csv_pools(spark, str(tmp_path), ["names", "years"]).orderBy("k").collect()
    assert [(r.names, r.years) for r in rows] == [("A b", "1"), (None, None)]


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("d", "x", None, [1])], "doc_id string, a string, b string, _lines array<int>")
    assert sinks.as_json(r).first().json == '{"a":"x","b":null}'
    sinks.write_json(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "b", "doc_id"]
    schema, ts = sinks.schemas(r)
    assert schema["properties"]["_lines"] == {"type": "array", "items": {"type": "integer"}} and "_lines: Array<number>;" in ts
    old = spark.createDataFrame([(1, "verified", "keep"), (2, "drafted", "old")], "id int, status string, v string")
    new = spark.createDataFrame([(1, "drafted", "new"), (2, "drafted", "new")], "id int, status string, v string")
    assert {(x.id, x.v) for x in sinks.draft(new, old).collect()} == {(1, "keep"), (2, "new")}
    assert "| a | 2.0 | 1.5 | 0.5 |" in sinks.report(spark.createDataFrame([("a", 2.0)], "label string, value double"), spark.createDataFrame([("a", 1.5)], "label string, value double"))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line\nmail{i}@example.org x" if i % 2 else "none") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.arriving(spark, str(tmp_path / "in"), "doc_id long, text string", 2)
    streaming.run_to_table(stream, str(tmp_path / "out"), streaming.contacts)
    got = spark.read.parquet(str(tmp_path / "out/table"))
    assert sorted(map(str, got.collect())) == sorted(map(str, streaming.contacts(docs).collect()))
    streaming.run_to_table(streaming.arriving(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), streaming.contacts)
    assert spark.read.parquet(str(tmp_path / "out/table")).count() == 20  # nothing twice


def test_stream_windows_and_state(spark, tmp_path):
    events = spark.range(100).select("id", (F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    names = ("w", "t", "s", "o")
    queries = [streaming.windowed_counts(source, "ts", "10 minutes", "5 minutes", "k"), streaming.running_totals(source, "k", "value"), streaming.sessions(source, "ts", "30 minutes", "1 hour", "k"), streaming.once(source.withColumn("text", F.col("k").cast("string")))]
    for name, q in zip(names, queries, strict=True):
        q.writeStream.format("memory").queryName(name).outputMode({"w": "complete", "t": "update", "s": "complete", "o": "append"}[name]).trigger(availableNow=True).start().awaitTermination()
    batch = streaming.windowed_counts(events, "ts", "10 minutes", "5 minutes", "k")
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, batch.collect()))
    assert spark.table("t").groupBy("k").agg(F.max("total").alias("x")).agg(F.sum("x")).first()[0] == sum(range(100))
    assert spark.table("s").agg(F.sum("n")).first()[0] == 100 and spark.table("o").count() == 4
