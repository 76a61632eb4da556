"""Chunks of documents: fixed windows, recursive splitting, sections, procedures, parents and children.

Each chunker takes ``elements`` (or a text) and returns ``(doc_id, position, chunk_id, chunk_type,
section, page, text)``, some with more. Islands, paths and positions are windows; only splitting
one long text, which is recursive, runs as an Arrow function on that text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import fixed as X
from ..functions.text import strip
from .elements import rendered, section_paths


SEGMENT = 16  # windows that are cut from one piece of a text


def check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0:
        raise ValueError("sizes must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")


def _chunk_id(strategy: str) -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(strategy), F.col("position").cast("string"))


# --- fixed windows ------------------------------------------------------------------------


def fixed_size(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``size`` characters, ``size - overlap`` apart, up to the one that reaches the
    end. Blank pieces take no position; ``char_start`` and ``char_end`` are the whole window. ``keep``: columns of a document
    that its windows get too."""
    check(size, overlap)
    step = size - overlap
    part = step * SEGMENT
    rows = docs.select("doc_id", *keep, F.col(text_col).alias("__text"), F.length(text_col).alias("__n")).filter("__n > 0")
    last = F.when(F.col("__n") <= size, F.lit(0)).otherwise(F.ceil((F.col("__n") - size) / step).cast("int"))
    # a character is found by counting from the start, so windows are cut from segments and not from the whole text
    segment = lambda s: F.substring(F.col("__text"), s * part + 1, F.lit(part + overlap))
    rows = rows.select("doc_id", *keep, "__n", last.alias("__last"), F.transform(F.sequence(F.lit(0), F.floor(last / SEGMENT).cast("int")), segment).alias("__segments"))
    piece = lambda text, s: lambda w: F.struct(
        strip(F.substring(text, (w - s * SEGMENT) * step + 1, F.lit(size))).alias("text"),
        (w * step).alias("char_start"),
        F.least(w * step + size, F.col("__n")).alias("char_end"),
    )
    of = lambda text, s: F.transform(F.sequence(s * SEGMENT, F.least(F.col("__last"), s * SEGMENT + (SEGMENT - 1))), piece(text, s))
    pieces = F.filter(F.flatten(F.transform("__segments", of)), lambda x: x["text"] != "")
    # made where the text lies: no row moves
    out = rows.select("doc_id", *keep, F.posexplode(pieces).alias("position", "piece"))
    return out.select("doc_id", "position", _chunk_id("fixed_size").alias("chunk_id"), "piece.text", "piece.char_start", "piece.char_end", *keep)


# --- recursive splitting ------------------------------------------------------------------


def _windows(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _parts(text: str, separator: str, size: int) -> list[str]:
    """Cut behind each separator; without one, into windows."""
    if not separator:
        return _windows(text, size)
    return re.findall(f"(?s).*?{re.escape(separator)}|.+", text)


def _joined(parts: Iterator[str], size: int, overlap: int) -> list[str]:
    """Parts put together while they fit; the next piece begins with the tail of the one before
    (an overlap of 0 takes all of it along)."""
    out, held = [], ""
    for part in parts:
        if held and len(held) + len(part) > size:
            out.append(held)
            held = held[-overlap:]
        held += part
    return out + [held] * bool(held.strip())


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = X.SEPARATORS) -> list[str]:
    """By the first separator, what is still too long by the next one, and so on; parts are put
    together at each level."""
    if len(text) <= size:
        return [text] if text.strip() else []

    def atoms() -> Iterator[str]:
        for part in _parts(text, separators[0], size):
            if len(part) <= size:
                if part.strip():
                    yield part
            elif separators[1:]:
                yield from split_text(part, size, overlap, separators[1:])
            else:
                yield from _windows(part, size)

    return _joined(atoms(), size, overlap)


def splitter(size: int, overlap: int):
    """Column of texts to column of their stripped, non-blank pieces."""
    check(size, overlap)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p.strip() for p in split_text(t or "", size, overlap) if p.strip()])

    return F.pandas_udf(run, ArrayType(StringType()))


_ROW = re.compile(r"(?ms)^\|.*?\|$(?=\n\||\n?\Z)")  # a row of a rendered table; its cells may hold line ends


def split_table(markdown: str, size: int, caption: str | None = None) -> list[str]:
    """A rendered table in pieces of ``size`` at most, each with the header; a row that is too
    long stands alone."""
    lines = _ROW.findall(markdown)
    head, body = lines[:2], lines[2:]
    start = (f"**Table: {caption}**\n\n" if caption else "") + "\n".join(head)
    out, held, length = [], [], len(start)
    for row in body:
        if held and length + 1 + len(row) > size:
            out.append("\n".join([start, *held]))
            held, length = [], len(start)
        held.append(row)
        length += 1 + len(row)
    return out + ["\n".join([start, *held])] * bool(held or not out)


def table_splitter(size: int):
    def run(tables: pd.Series, captions: pd.Series) -> pd.Series:
        return pd.Series([split_table(t or "", size, c) for t, c in zip(tables, captions)])

    return F.pandas_udf(run, ArrayType(StringType()))


def _numbered(pieces: DataFrame, strategy: str, *order: str) -> DataFrame:
    out = pieces.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    first = ["doc_id", "position", "chunk_id", "chunk_type", "section", "page", "text"]
    return out.withColumn("chunk_id", _chunk_id(strategy)).select(*first)


def segments(elements: DataFrame) -> DataFrame:
    """Tables on their own and the text between them, which ends at a new page too."""
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    rows = rendered(elements).withColumn("is_table", F.col("type") == "table")
    rows = rows.withColumn("stretch", F.sum(F.col("is_table").cast("int")).over(so_far))
    before = Window.partitionBy("doc_id", "stretch", "is_table").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last("page", ignorenulls=True).over(before)
    turn = (F.col("page") != seen) & ~F.col("is_table")
    rows = rows.withColumn("turn", F.coalesce(turn, F.lit(False)).cast("int"))
    rows = rows.withColumn("leaf", F.sum("turn").over(Window.partitionBy("doc_id", "stretch", "is_table").orderBy("pos")))
    return (
        rows.groupBy("doc_id", "stretch", "is_table", "leaf")
        .agg(
            F.min("pos").alias("pos"),
            F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("parts"),
            F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("page"),
        )
        .select(
            "doc_id",
            "pos",
            F.when(F.col("is_table"), "table").otherwise("text").alias("chunk_type"),
            F.array_join(F.transform("parts", lambda x: x["rendered"]), "\n\n").alias("text"),
            "page",
        )
    )


def recursive(elements: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Segments split recursively; long tables by rows, without rows that hold three dashes."""
    check(size, overlap)
    rows = segments(elements).withColumn("section", F.lit(None).cast("string"))
    text = rows.filter("chunk_type = 'text'").withColumn("pieces", splitter(size, overlap)("text"))
    table = rows.filter("chunk_type = 'table'")
    small = table.filter(F.length("text") <= size).withColumn("pieces", F.array("text"))
    large = table.filter(F.length("text") > size)
    lines = F.regexp_extract_all("text", F.lit(r"(?ms)^\|.*?\|$(?=\n\||\n?\z)"), F.lit(0))
    kept = F.filter(lines, lambda x, i: (i == 1) | ~x.contains("---"))
    large = large.withColumn("pieces", table_splitter(size)(F.array_join(kept, "\n"), F.lit(None).cast("string")))
    both = text.unionByName(small).unionByName(large)
    return _numbered(
        both.select("doc_id", "pos", "chunk_type", "section", "page", F.posexplode("pieces").alias("no", "text")),
        "recursive",
        "pos",
        "no",
    )


def structural(elements: DataFrame, size: int = 1500, overlap: int = 100) -> DataFrame:
    """Sections by their headings and pages: first the text, with its path in front, then tables."""
    check(size, overlap)
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    heads = elements.withColumn("sec", F.sum((F.col("type") == "heading").cast("int")).over(so_far))
    rows = section_paths(rendered(heads))
    before = Window.partitionBy("doc_id", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.col("page") != F.last("page", ignorenulls=True).over(before), F.lit(False))
    rows = rows.withColumn("turn", turn.cast("int"))
    rows = rows.withColumn("leaf", F.sum("turn").over(Window.partitionBy("doc_id", "sec").orderBy("pos")))
    rows = rows.withColumn("section", F.when(F.col("section") != "", F.col("section")))
    text = (
        rows.filter("type <> 'table'")
        .groupBy("doc_id", "sec", "leaf", "section")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("parts"),
            F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("page"),
        )
        .withColumn("body", strip(F.array_join(F.transform("parts", lambda x: x["rendered"]), "\n\n")))
        .filter("body <> ''")
        .withColumn("body", F.concat_ws("\n\n", "section", "body"))
    )
    text = _cut_long(text, "body", size, splitter(size, overlap)("body"))
    text = text.select("doc_id", "sec", "leaf", F.lit(-1).alias("pos"), F.lit("text").alias("chunk_type"), "section", "page", F.posexplode("pieces").alias("no", "text"))
    table = _cut_long(rows.filter("type = 'table'"), "table", size, table_splitter(size)("table", "section"))
    table = table.select("doc_id", "sec", "leaf", "pos", F.lit("table").alias("chunk_type"), "section", "page", F.posexplode("pieces").alias("no", "text"))
    both = text.unionByName(table).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    return _numbered(both, "structural", "sec", "leaf", "pos", "no")


def _cut_long(rows: DataFrame, column: str, size: int, pieces: Column) -> DataFrame:
    """Adds ``pieces``: the column itself where it fits; only longer ones reach Python."""
    short = rows.filter(F.length(column) <= size).withColumn("pieces", F.array(column))
    return short.unionByName(rows.filter(F.length(column) > size).withColumn("pieces", pieces))


# --- procedures ---------------------------------------------------------------------------


def table_title(text: Column) -> Column:
    """A title for a table by the words that it holds; null if no rule fits."""
    out = None
    for words, title in X.TABLE_TITLES:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, title) if out is None else out.when(hit, title)
    return out


def with_title(title: Column, text: Column) -> Column:
    t, body = strip(title), strip(text)
    return F.when((F.coalesce(t, F.lit("")) == "") | body.startswith(t), body).otherwise(F.concat(t, F.lit("\n\n"), body))


def is_procedure_start(text: Column) -> Column:
    return F.coalesce(F.element_at(F.split(strip(text), X.LINE_END), 1).rlike(X.PROCEDURE_START), F.lit(False))


def procedures(elements: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """A new group at each line that starts a procedure, whose whole text is the title.

    Tables stand alone between the texts of a group. Without a procedure so far, the first table
    that follows text and whose words give a title names that text and all after it. A text's page
    is the first of its own elements'.
    """
    check(size, overlap)
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    rows = rendered(elements).withColumns(
        {
            "is_table": F.col("type") == "table",
            "start": (F.col("type") != "table") & is_procedure_start(F.coalesce("text", F.lit(""))),
        }
    )
    rows = rows.withColumns(
        {
            "grp": F.sum(F.col("start").cast("int")).over(so_far),
            "seg": F.sum((F.col("is_table") | F.col("start")).cast("int")).over(so_far),
            "guess": F.when(F.col("is_table"), table_title(strip(F.col("rendered")))),
            "after_text": F.coalesce(~F.lag("is_table").over(so_far), F.lit(False)),
        }
    )
    group = Window.partitionBy("doc_id", "grp")
    named = F.when(F.col("grp") > 0, F.min(F.when(F.col("start"), strip(F.col("text")))).over(group))
    naming = (F.col("grp") == 0) & F.col("after_text") & F.col("guess").isNotNull()
    rows = rows.withColumns(
        {"named": named, "at": F.min(F.when(naming, F.struct("pos", "seg", "guess"))).over(group)}
    )
    inferred = F.when(F.col("seg") >= F.col("at.seg") - 1, F.col("at.guess"))
    title = F.coalesce(F.col("named"), inferred)
    rows = rows.withColumn("title", F.when(F.col("is_table"), F.coalesce(title, F.col("guess"))).otherwise(title))
    text = (
        rows.filter("not is_table")
        .groupBy("doc_id", "grp", "seg")
        .agg(
            F.min("pos").alias("pos"),
            F.min("title").alias("title"),
            F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("parts"),
            F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("page"),
        )
        .withColumn("body", strip(F.array_join(F.transform("parts", lambda x: x["rendered"]), "\n\n")))
        .filter("body <> ''")
    )
    text = _cut_long(text, "body", size, splitter(size, overlap)("body"))
    text = text.select("doc_id", "pos", F.lit("text").alias("chunk_type"), "title", "page", F.posexplode("pieces").alias("no", "piece"))
    table = _cut_long(rows.filter("is_table"), "table", size, table_splitter(size)("table", "title"))
    table = table.select("doc_id", "pos", F.lit("table").alias("chunk_type"), "title", "page", F.posexplode("pieces").alias("no", "piece"))
    both = text.unionByName(table).select(
        "doc_id", "pos", "no", "chunk_type", F.col("title").alias("section"), "page", with_title(F.col("title"), F.col("piece")).alias("text")
    )
    return _numbered(both.filter("text <> ''"), "procedure", "pos", "no")


def parent_child(elements: DataFrame, parent: int = 2400, child: int = 700, overlap: int = 100) -> DataFrame:
    """Procedures of ``parent`` characters and, of each, children of ``child`` with its title. A
    child keeps its parent's kind and section, its text, and its number among its siblings."""
    check(child, overlap)
    if child > parent:
        raise ValueError("child must not exceed parent")
    parents = procedures(elements, parent, min(150, max(1, parent // 10)))
    kids = _cut_long(parents, "text", child, splitter(child, overlap)("text"))
    kids = kids.withColumn("child_count", F.size("pieces")).select("*", F.posexplode("pieces").alias("child_index", "piece"))
    order = Window.partitionBy("doc_id").orderBy("parent_position", "child_index")
    out = kids.withColumnsRenamed({"position": "parent_position", "text": "parent_text"}).withColumn(
        "position", F.row_number().over(order) - 1
    )
    return out.select(
        "doc_id",
        "position",
        _chunk_id("parent_child").alias("chunk_id"),
        "chunk_type",
        "section",
        "page",
        with_title(F.col("section"), F.col("piece")).alias("text"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("parent"), F.col("parent_position").cast("string")).alias("parent_id"),
        "parent_position",
        "parent_text",
        "child_index",
        "child_count",
    )


CHUNKERS = {"recursive": recursive, "structural": structural, "procedure": procedures, "parent_child": parent_child}


def chunk(elements: DataFrame, strategy: str = "parent_child", **sizes: int) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown strategy {strategy!r}: one of {', '.join(CHUNKERS)}")
    return CHUNKERS[strategy](elements, **sizes)
