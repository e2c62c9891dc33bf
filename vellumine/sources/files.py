"""Binary files as line documents: kinds, catalogue, DOCX. PDF and page recognition need libraries that are optional."""

import importlib.util
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINES

MOST_BYTES, MOST_PAGES = 10 << 20, 5
POINTS_A_LINE, PAGE = 14.0, (600.0, 800.0)
STATUSES = ("ok", "too_large", "unsupported", "unreadable", "too_many_pages")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ENGINES: dict[str, Callable[[bytes, int], list[dict]]] = {}  # name -> (page image, dpi) -> words


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, filename, category, stem, length, content``: category is the folder's name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("filename"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("category"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "content")


def kind(content: Column, filename: Column) -> Column:
    """pdf, docx or unsupported, by first bytes and extension. Old .doc files are unsupported: no converter runs in a task."""
    name = F.lower(filename)
    plain = ~F.substring_index(name, "/", -1).contains(".")
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when((F.substring(content, 1, 2) == F.lit(b"PK")) & (name.endswith(".docx") | plain), "docx").otherwise("unsupported")


def with_status(found: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds ``kind, status``; files that can't be read are rows with a status, not failures of the job."""
    out = found.withColumn("kind", kind(F.col("content"), F.col("filename")))
    return out.withColumn("status", F.when(F.octet_length("content") > most_bytes, "too_large").when(F.col("kind") == "unsupported", "unsupported").otherwise("ok"))


def _runs(paragraph: ElementTree.Element) -> list[tuple[str, bool, bool]]:
    out = []
    for run in paragraph.iter(f"{WORD}r"):
        style = run.find(f"{WORD}rPr")
        flags = [style is not None and (x := style.find(f"{WORD}{k}")) is not None and x.get(f"{WORD}val") not in ("0", "false") for k in ("b", "i")]
        text = "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" for t in run if t.tag in (f"{WORD}t", f"{WORD}tab"))
        if text:
            out.append((text, *flags))
    return out


def docx_lines(content: bytes) -> tuple[list[tuple[str, list, float]], list[str]]:
    """((text, runs, size) of each paragraph, then of each table row with TABs between cells; hyperlink targets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = set(z.namelist())
        relations = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
    targets = {r.get("Id"): r.get("Target") for r in relations}
    lines = []
    for p in body.findall(f"{WORD}p"):
        runs = _runs(p)
        text = "".join(t for t, _, _ in runs)
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        style = style.get(f"{WORD}val", "").lower() if style is not None else ""
        listed = p.find(f"{WORD}pPr/{WORD}numPr") is not None or style.startswith("list")
        heading = style.startswith(("heading", "title"))
        if text.strip():
            lines.append((("• " if listed else "") + text, [(t, b or heading, i) for t, b, i in runs], 14.0 if heading else 11.0))
    for row in body.iter(f"{WORD}tr"):
        cells = [" ".join("".join(t for t, _, _ in _runs(p)) for p in c.iter(f"{WORD}p")).strip() for c in row.findall(f"{WORD}tc")]
        if any(cells):
            lines.append(("\t".join(cells), [], 11.0))
    links = [targets[h.get(f"{RELATION}id")] for h in body.iter(f"{WORD}hyperlink") if targets.get(h.get(f"{RELATION}id"))]
    return lines, links


def docx_documents(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, links and unreadable documents of the DOCX rows of ``found`` (path, filename, content)."""
    parsed_schema = "doc_id string, filename string, ok boolean, lines array<struct<text:string,bolds:array<boolean>,italics:array<boolean>,parts:array<string>,size:double>>, uris array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, name, content in zip(part["path"], part["filename"], part["content"], strict=True):
                try:
                    lines, uris = docx_lines(content)
                    rows.append((path, name, True, [{"text": t, "bolds": [b for _, b, _ in r], "italics": [i for _, _, i in r], "parts": [x for x, _, _ in r], "size": s} for t, r, s in lines], uris))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError):
                    rows.append((path, name, False, [], []))
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "ok", "lines", "uris"])

    done = found.select("path", "filename", "content").mapInPandas(run, parsed_schema)
    y0 = F.col("line_ord") * POINTS_A_LINE
    box = F.struct(F.lit(40.0).alias("x0"), y0.alias("y0"), F.least(F.lit(PAGE[0] - 40), 40 + 5.0 * F.length("l.text")).alias("x1"), (y0 + 11.0).alias("y1"))
    each = done.filter("ok").select("doc_id", "filename", F.posexplode("lines").alias("line_ord", "l"))
    spans = F.transform("l.parts", lambda p, i: F.struct(p.alias("text"), box.alias("bbox"), F.col("l.size").alias("size"), F.col("l.bolds")[i].alias("bold"), F.col("l.italics")[i].alias("italic"), F.lit("").alias("font"), F.lit(0).alias("color")))
    lines = each.select("doc_id", "filename", F.lit(0).alias("page_no"), F.lit(PAGE[0]).alias("page_width"), F.lit(PAGE[1]).alias("page_height"), "line_ord", F.col("l.text").alias("text"), box.alias("bbox"), spans.alias("spans"), F.lit("docx").alias("source"))
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
    links = done.filter("ok").select("doc_id", F.lit(0).alias("page_no"), F.posexplode("uris").alias("link_ord", "uri")).select("doc_id", "page_no", "link_ord", none.alias("bbox"), "uri")
    return lines, links, done.filter("not ok").select("doc_id", F.lit("unreadable").alias("status"))


def bold_font(name: Column) -> Column:
    """Whether a font's name says that it is bold."""
    return name.rlike(r"(?i)bold|black|heavy|semibold|demi|-bd\b")


def pdf_documents(found: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """Lines of the PDF rows, one row a line (``schema.LINES``); needs a PDF library where the tasks run."""
    if importlib.util.find_spec("pymupdf") is None:
        raise NotImplementedError("reading PDF files needs the optional library pymupdf")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for part in parts:
            rows = []
            for path, name, content in zip(part["path"], part["filename"], part["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc if len(doc) <= most_pages else ()):
                        found_lines = [x for b in page.get_text("dict")["blocks"] for x in b.get("lines", ())]
                        for k, line in enumerate(found_lines):
                            box = dict(zip(("x0", "y0", "x1", "y1"), line["bbox"], strict=True))
                            spans = [{"text": s["text"], "bbox": dict(zip(("x0", "y0", "x1", "y1"), s["bbox"], strict=True)), "size": s["size"], "bold": bool(s["flags"] & 16 or re.search("(?i)bold|black|heavy", s["font"])), "italic": bool(s["flags"] & 2), "font": s["font"], "color": s["color"]} for s in line["spans"]]
                            rows.append((path, name, n, page.rect.width, page.rect.height, k, "".join(s["text"] for s in spans), box, spans, "pdf"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return found.select("path", "filename", "content").mapInPandas(run, LINES)


def engine(name: str) -> Callable[[bytes, int], list[dict]]:
    """A recogniser registered in ``ENGINES``."""
    if name not in ENGINES:
        raise NotImplementedError(f"no recogniser {name!r} is registered")
    return ENGINES[name]


def recognised_words(pages: DataFrame, name: str, dpi: int = 300) -> DataFrame:
    """Words of page images (doc_id, page_no, image) by a registered recogniser; give them to ``lines.recognised_lines``."""
    read = engine(name)
    schema = "doc_id string, page_no int, block int, par int, line int, word int, text string, conf double, left double, top double, width double, height double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"doc_id": d, "page_no": n, **w} for d, n, image in zip(part["doc_id"], part["page_no"], part["image"], strict=True) for w in read(image, dpi)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.mapInPandas(run, schema)


