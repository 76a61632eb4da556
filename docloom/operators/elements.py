"""Documents as elements: one row for each heading, paragraph, list item or table.

``elements(doc_id, pos, type, text, level, page, table)``; ``table`` is the rendered Markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import blank, render, strip, table_markdown


def text_elements(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Paragraphs between blank lines. ``docs(doc_id, text)``."""
    text = F.col("text") if text is None else text
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")
    # made where the text lies: no row moves
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text")).select(
        "doc_id",
        "pos",
        F.lit("paragraph").alias("type"),
        "text",
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("string").alias("table"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", X.LINE_END)).alias("at", "line"))


def markdown_elements(docs: DataFrame) -> DataFrame:
    """Markdown by islands of lines: a heading or a table ends what came before, a blank line ends
    a paragraph. A table is a row with bars that a separator row follows, and the rows after it."""
    order = Window.partitionBy("doc_id").orderBy("at")
    row = F.col("line").rlike(r"^\|(.+)\|\s*$")
    rule = F.col("line").rlike(r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$")
    lines = _lines(docs).withColumns(
        {"row": row, "rule": rule, "heading": F.col("line").rlike(r"^#{1,6}\s+.*$"), "empty": blank(F.col("line"))}
    )
    # a row opens a table if the next line is a rule; the table runs on over rows
    lines = lines.withColumn("opens", F.col("row") & ~F.col("heading") & F.coalesce(F.lead("rule").over(order), F.lit(False)))
    breaks = ~F.col("row") & ~F.coalesce(F.lag("opens").over(order), F.lit(False))
    lines = lines.withColumn("run", F.sum(breaks.cast("int")).over(order))
    lines = lines.withColumn("first_open", F.min(F.when(F.col("opens"), F.col("at"))).over(Window.partitionBy("doc_id", "run")))
    in_table = F.coalesce(F.col("at") >= F.col("first_open"), F.lit(False)) & ~breaks
    lines = lines.withColumn("in_table", in_table).withColumn(
        "kind", F.when(F.col("in_table"), "table").when(F.col("heading"), "heading").when(F.col("empty"), "blank").otherwise("paragraph")
    )
    new = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
    lines = lines.withColumn("new", (new | (F.coalesce(F.col("first_open") == F.col("at"), F.lit(False)))).cast("int"))
    lines = lines.withColumn("island", F.sum("new").over(order)).filter("kind <> 'blank'")
    skip = (F.col("kind") == "table") & (F.col("at") == F.col("first_open") + 1)
    groups = (
        lines.filter(~skip)
        .groupBy("doc_id", "island", "kind")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    )
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    cells = F.transform(
        F.col("lines"),
        lambda x: F.transform(F.split(F.regexp_replace(strip(x["line"]), r"^\|+|\|+$", ""), r"\|"), strip),
    )
    out = groups.withColumns(
        {
            "text": F.when(F.col("kind") == "heading", strip(F.regexp_replace(joined, r"^#{1,6}\s+", "")))
            .when(F.col("kind") == "table", F.lit(""))
            .otherwise(strip(joined)),
            "level": F.when(F.col("kind") == "heading", F.length(F.regexp_extract(joined, r"^(#{1,6})", 1))),
            "table": F.when(F.col("kind") == "table", table_markdown(cells)),
        }
    ).filter("kind <> 'paragraph' or text <> ''")
    number = Window.partitionBy("doc_id").orderBy("island")
    return out.select(
        "doc_id",
        (F.row_number().over(number) - 1).alias("pos"),
        F.col("kind").alias("type"),
        "text",
        "level",
        F.lit(None).cast("int").alias("page"),
        "table",
    )


def is_heading(line: Column) -> Column:
    """Whether a line of a scanned page looks like a heading."""
    words = "|".join(X.PAGE_HEADING_WORDS)
    arabic = (
        (F.regexp_count(line, F.lit(f"[{X.ARABIC}]")) >= 3)
        & (F.length(line) <= 90)
        & ~line.rlike(r"[؛:,.،!?؟]")
        & ~line.rlike(r"\p{Nd}{2,}")
        & line.rlike(words)
    )
    marks = line.rlike(X.PAGE_PROCEDURE) | line.rlike(X.PAGE_NUMBERED) | line.rlike(X.PAGE_SECTION)
    return (line != "") & (F.length(line) <= 180) & (marks | arabic)


def page_elements(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text)``: headings by their look, other lines joined to paragraphs."""
    lines = pages.select(
        "doc_id", "page", F.posexplode(F.split("text", X.LINE_END)).alias("at", "raw")
    ).withColumn("line", strip(F.col("raw")))
    order = Window.partitionBy("doc_id", "page").orderBy("at")
    lines = lines.withColumn(
        "kind", F.when(F.col("line") == "", "blank").when(is_heading(F.col("line")), "heading").otherwise("paragraph")
    )
    new = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
    lines = lines.withColumn("island", F.sum(new.cast("int")).over(order)).filter("kind <> 'blank'")
    groups = lines.groupBy("doc_id", "page", "island", "kind").agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    level = F.when(F.col("kind") == "heading", F.when(text.rlike(X.PAGE_PROCEDURE), 2).otherwise(3))
    number = Window.partitionBy("doc_id").orderBy("page", "island")
    return groups.select(
        "doc_id",
        (F.row_number().over(number) - 1).alias("pos"),
        F.col("kind").alias("type"),
        text.alias("text"),
        level.alias("level"),
        "page",
        F.lit(None).cast("string").alias("table"),
    )


def rendered(elements: DataFrame) -> DataFrame:
    return elements.withColumn("rendered", render(F.col("type"), F.col("text"), F.col("level"), F.col("table")))


def full_text(elements: DataFrame) -> DataFrame:
    """``(doc_id, full_text)``: the rendered elements of a document in order."""
    return (
        rendered(elements)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("parts"))
        .select("doc_id", F.array_join(F.transform("parts", lambda x: x["rendered"]), "\n\n").alias("full_text"))
    )


def section_paths(elements: DataFrame, levels: int = 6) -> DataFrame:
    """Elements other than headings with ``section``, the headings above them joined by `` > ``.

    A heading of level k is in force iff it stands after the last heading of each lower level; so
    running maxima of positions by level tell the path, without a loop over elements.
    """
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {
        f"h{k}": F.max(
            F.when((F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) == k), F.struct("pos", "text"))
        ).over(so_far)
        for k in range(1, levels + 1)
    }
    out = elements.withColumns(last).filter("type <> 'heading'")
    parts = []
    for k in range(1, levels + 1):
        pos = F.col(f"h{k}.pos")
        above = [F.coalesce(pos > F.col(f"h{j}.pos"), F.lit(True)) for j in range(1, k)]
        holds = pos.isNotNull()
        for a in above:
            holds = holds & a
        parts.append(F.when(holds, F.col(f"h{k}.text")))
    return out.withColumn("section", F.concat_ws(" > ", *parts)).drop(*last)
