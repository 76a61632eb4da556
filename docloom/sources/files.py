"""Files of mixed formats to elements.

``scan`` lists a folder with Spark's binary source; text and Markdown are split with expressions,
HTML, CSV and DOCX by a parser for each file, in the tasks. A file that can't be parsed gives no
elements and a row with ``_error``; the others go on.
"""

from __future__ import annotations

import csv
import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elements import markdown_elements, page_elements, text_elements
from ..operators.hooks import PageExtractor
from . import layout, ocr

FORMATS = {
    ".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "csv",
    ".pdf": "pdf", ".docx": "docx",
}
PARSED = "doc_id string, pos long, type string, text string, level int, page int, table string, _error string"
_BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(doc_id, path, format, content)``: files with a known ending; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[ending]
    return files.select(F.substring(F.sha2("path", 256), 1, 16).alias("doc_id"), "path", kind.alias("format"), "content").filter("format is not null")


def format_of(path):
    """The format by a path's ending; an error for unknown ones."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[ending]
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown format: "), path)))


class _Node:
    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children = tag, parent, []

    def walk(self):
        """All nodes and strings below, in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                yield c
                if isinstance(c, _Node):
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        return " ".join(s.strip() for s in self.walk() if isinstance(s, str) and s.strip())

    def find(self, tags):
        return (c for c in self.walk() if isinstance(c, _Node) and c.tag in tags)


class _Tree(HTMLParser):
    """The nesting of tags as they stand; no tag is closed but by its end tag or its parent's."""

    def __init__(self, source: str):
        super().__init__()
        self.root = self.at = _Node("", None)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def _markdown(rows: list[list[str]], caption: str | None = None) -> str:
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cell = lambda c: (c or "").strip()
    out = [line(map(cell, rows[0])), line(["---"] * width)]
    out += [line([cell(c) for c in (r + [""] * width)[:width]]) for r in rows[1:]]
    return (f"**Table: {caption}**\n\n" if caption else "") + "\n".join(out)


def html_elements(source: str) -> list[tuple]:
    root = _Tree(source).root
    body = next(root.find(("body",)), root)
    out = []
    for tag in body.find(_BLOCKS):
        if tag.tag == "table":
            rows = [[c.text() for c in tr.find(("td", "th"))] for tr in tag.find(("tr",))]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append(("table", "", None, _markdown(rows)))
        elif text := tag.text():
            kind = "heading" if tag.tag[0] == "h" else "list_item" if tag.tag == "li" else "paragraph"
            out.append((kind, text, int(tag.tag[1]) if kind == "heading" else None, None))
    return out


def csv_elements(source: str, name: str) -> list[tuple]:
    rows = [r for r in csv.reader(io.StringIO(source, newline="")) if any(c.strip() for c in r)]
    return [("table", "", None, _markdown(rows, name))]


def docx_elements(content: bytes) -> list[tuple]:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    text = lambda n: "".join(t.text or "" for t in n.iter(f"{ns}t")).strip()
    out = []
    for node in body:
        if node.tag == f"{ns}p" and text(node):
            style = node.find(f"{ns}pPr/{ns}pStyle")
            name = (style.get(f"{ns}val") if style is not None else "").lower().replace(" ", "")
            level = int(name[7]) if name.startswith("heading") and name[7:8].isdigit() else None
            out.append(("heading" if level else "paragraph", text(node), level, None))
        elif node.tag == f"{ns}tbl":
            rows = [["\n".join(filter(None, map(text, c.iter(f"{ns}p")))) for c in r.iter(f"{ns}tc")] for r in node.iter(f"{ns}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append(("table", "", None, _markdown(rows)))
    return out


def _parse(content: bytes, kind: str, path: str) -> list[tuple]:
    if kind == "docx":
        return docx_elements(content)
    source = content.decode("utf-8", "replace")
    return html_elements(source) if kind == "html" else csv_elements(source, path.rpartition("/")[2])


def parsed(files: DataFrame) -> DataFrame:
    """Elements of HTML, CSV and DOCX files; ``_error`` says why a file has none."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, path, kind, content in batch.itertuples(index=False):
                try:
                    found = _parse(bytes(content), kind, path)
                    out += [(doc, i, k, t, lv, None, tb, None) for i, (k, t, lv, tb) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a bad file is reported and skipped
                    out.append((doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            names = [c.split()[0] for c in PARSED.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"pos": "Int64", "level": "Int32", "page": "Int32"})

    some = files.filter(F.col("format").isin("html", "csv", "docx"))
    return some.select("doc_id", "path", "format", "content").mapInPandas(run, PARSED)


def pdf_elements(files: DataFrame, extractor: PageExtractor) -> DataFrame:
    """``files(doc_id, path, content)`` by an extractor. One with ``extract(content)`` works file by file, a failing one
    gives a row with ``_error``: its pages have tables, whose tokens leave the text and fill cells (``layout``), and native
    text where recognition is weak or finds nothing. One with ``tokens(files)`` alone gives lines of each page, the native text
    where recognition is weak (``native``, if the tokens have that column). Headings are told by their look."""
    columns = ["doc_id", "pos", "type", "text", "level", "page", "table", "_error"]
    none = F.lit(None).cast("string").alias("_error")
    if hasattr(extractor, "extract"):
        parts, failed = layout.extracted(files, extractor.extract)
        found = layout.elements(parts["tokens"], parts["pages"], parts["boxes"], parts["cells"])
        bad = failed.select("doc_id", *(F.lit(None).alias(c) for c in columns[1:-1]), "_error")
        return found.select(*columns[:-1], none).unionByName(bad)
    tokens = extractor.tokens(files)
    pages = ocr.page_stats(tokens).join(ocr.page_text(tokens), ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    if "native" in tokens.columns:
        native = tokens.groupBy("doc_id", "page").agg(F.max("native").alias("native"))
        pages = ocr.best_text(pages.join(native, ["doc_id", "page"]).withColumn("native", F.coalesce("native", F.lit(""))))
    return page_elements(pages.select("doc_id", "page", "text")).withColumn("_error", none)


def read_folder(spark: SparkSession, path: str, recursive: bool = True, extractor: PageExtractor | None = None) -> DataFrame:
    """All elements of a folder's files. Bytes that are no UTF-8 become U+FFFD. PDF files need an
    ``extractor``; without one each gives a row with ``_error``."""
    files = scan(spark, path, recursive)
    texts = files.filter(F.col("format").isin("txt", "markdown"))
    texts = texts.select("doc_id", "format", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    plain = text_elements(texts.filter("format = 'txt'"))
    marked = markdown_elements(texts.filter("format = 'markdown'"))
    columns = ["doc_id", "pos", "type", "text", "level", "page", "table"]
    native = plain.select(*columns).unionByName(marked.select(*columns)).withColumn("_error", F.lit(None).cast("string"))
    pdf = files.filter("format = 'pdf'")
    if extractor:
        pages = pdf_elements(pdf, extractor).select(*columns, "_error")
    else:
        pages = pdf.select("doc_id", *(F.lit(None).alias(c) for c in columns[1:]), F.lit("no extractor for PDF").alias("_error"))
    return native.unionByName(parsed(files)).unionByName(pages)
