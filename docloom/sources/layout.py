"""Pages with tables: which recognised tokens lie in a table, and in which of its cells.

``tokens(doc_id, page, block_num, par_num, line_num, word_num, text, conf, x0, top, x1, bottom)``,
``boxes(doc_id, page, table_no, x0, top, x1, bottom[, caption])`` of tables and ``cells(doc_id, page, table_no, cell_no, x0, top, x1,
bottom)``. A token belongs where its middle lies. Tokens of tables leave the page's text and fill cells.

Tokens meet the boxes of their page as a list. Where a page has many boxes the join is an equi-join on cells of a grid that is as
coarse as each box is large (steps of two), so a box touches nine of its cells at most; a token looks into one cell for each step
that its page has.

Defined cases: edges belong to a box; of several boxes that hold a token the one of the smallest number takes it; boxes
without an area, or with a null or not finite edge, hold nothing; tokens without a place are in no table; a table none of whose
cells has text is no element; a page without tokens keeps its native text; a file that can't be extracted gives one row
with ``_error`` and the others go on; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import table_markdown
from ..operators.elements import page_elements
from ..operators.retrieval import BROADCAST_ROWS, small
from ..operators.written import written
from . import ocr

FEW = 64  # boxes of a page that are looked through for each of its tokens
KEYS = 1_000_000  # pages or tables whose keys alone are sent to all executors
GRID = 64.0  # width of the finest cells, in units of the page
EDGES = ("x0", "top", "x1", "bottom")
TOKENS = "page int, block_num int, par_num int, line_num int, word_num int, text string, conf string, x0 double, top double, x1 double, bottom double"
PAGES = "page int, width double, height double, native string"
BOXES = "page int, table_no int, x0 double, top double, x1 double, bottom double, caption string"
CELLS = "page int, table_no int, cell_no int, x0 double, top double, x1 double, bottom double"
PARTS = {"tokens": TOKENS, "pages": PAGES, "boxes": BOXES, "cells": CELLS}


def _finite(*edges: Column) -> Column:
    out = F.lit(True)
    for e in edges:
        out = out & e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return out


def _among(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` stand in the written table ``known``; up to KEYS of them go to the rows, which then don't move."""
    return rows.join(small(known.select(*keys), KEYS), keys, "left_semi")


def _inside(x: Column, y: Column, edge: Callable[[str], Column]) -> Column:
    return x.between(edge("x0"), edge("x1")) & y.between(edge("top"), edge("bottom"))


def held(tokens: DataFrame, boxes: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``tokens`` plus ``number``, that of the first box of the same ``keys`` that holds the token's middle, or null.

    Only boxes whose keys a token has are looked at. A key's boxes go to its tokens as a list, up to FEW of them; those
    of keys with more are met by the grid."""
    edge = {e: F.col(e).cast("double") for e in EDGES}
    good = boxes.filter(_finite(*edge.values()) & (edge["x1"] > edge["x0"]) & (edge["bottom"] > edge["top"]))
    good = good.select(*keys, number, *(edge[e].alias(f"b_{e}") for e in EDGES))
    pages = written(tokens.select(*keys).distinct(), "layout-keys")
    good = written(_among(good, pages, keys), "layout-boxes")
    many = written(good.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select(*keys), "layout-many")
    x, y = (F.col("x0") + F.col("x1")).cast("double") / 2, (F.col("top") + F.col("bottom")).cast("double") / 2
    rows = tokens.drop(number)
    if many.limit(1).count():
        grid = _by_grid(_among(rows, many, keys).withColumns({"t_x": x, "t_y": y}), _among(good, many, keys), keys, number)
        rows, good = (df.join(small(many, KEYS), keys, "left_anti") for df in (rows, good))
    lists = good.groupBy(*keys).agg(F.collect_list(F.struct(number, *(F.col(f"b_{e}").alias(e) for e in EDGES))).alias("t_boxes"))
    if good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    holding = F.filter("t_boxes", lambda b: F.coalesce(_inside(x, y, lambda e: b[e]), F.lit(False)))
    first = F.array_min(F.transform(holding, lambda b: b[number])).alias(number)
    out = rows.join(lists, keys, "left").select(*(F.col(c) for c in rows.columns), first)
    return out.unionByName(grid) if many.limit(1).count() else out


def _by_grid(rows: DataFrame, boxes: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``held`` for keys with any number of boxes: an equi-join on cells of a grid."""
    size = F.greatest(F.col("b_x1") - F.col("b_x0"), F.col("b_bottom") - F.col("b_top"))
    good = boxes.withColumn("step", F.greatest(F.lit(0), F.ceil(F.log2(size / GRID))).cast("int"))
    wide = lambda step: F.lit(GRID) * F.pow(F.lit(2.0), step)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / wide(F.col("step"))), F.floor(F.col(b) / wide(F.col("step"))))
    good = good.withColumn("gx", F.explode(span("b_x0", "b_x1"))).withColumn("gy", F.explode(span("b_top", "b_bottom")))
    good = written(good, "layout-grid")
    rows = written(rows.withColumn("t_id", F.monotonically_increasing_id()), "layout-tokens")  # the ids are fixed by being written
    steps = good.groupBy(*keys).agg(F.collect_set("step").alias("steps"))
    asks = rows.filter(_finite(F.col("t_x"), F.col("t_y"))).select("t_id", *keys, "t_x", "t_y").join(small(steps), keys)
    asks = asks.withColumn("step", F.explode("steps")).drop("steps")
    cell = lambda v: F.floor(F.col(v) / wide(F.col("step")))
    asks = asks.withColumns({"gx": cell("t_x"), "gy": cell("t_y")})
    inside = _inside(F.col("t_x"), F.col("t_y"), lambda e: F.col(f"b_{e}"))
    found = asks.join(good, [*keys, "step", "gx", "gy"]).filter(inside).groupBy("t_id").agg(F.min(number).alias(number))
    return rows.drop("t_x", "t_y").join(found, "t_id", "left").drop("t_id")


def tables(tokens: DataFrame, boxes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens with ``table_no``, tables): ``(doc_id, page, table_no, caption, rows, markdown)``. A cell's text is what a page's
    text would be, in one line; rows and columns are those of ``ocr.cell_rows``, rows without any text go. Cells and captions are
    taken of tables with text only."""
    page, table, cell = list(ocr.PAGE), [*ocr.PAGE, "table_no"], (*ocr.PAGE, "table_no", "cell_no")
    placed = held(tokens, boxes, page, "table_no")
    within = written(placed.filter("table_no is not null"), "layout-placed")
    texts = ocr.page_text(held(within, cells, table, "cell_no").filter("cell_no is not null"), cell)
    texts = written(texts.withColumn("text", F.regexp_replace("text", "\n", " ")).filter("text <> ''"), "layout-texts")
    told = written(texts.select(*table).distinct(), "layout-told")
    filled = _among(cells, told, table).select(*cell, "x0", "top").join(texts, list(cell), "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = ocr.cell_rows(filled).groupBy(*table, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    rows = rows.withColumn("c", F.transform("c", lambda x: x["text"])).filter(F.exists("c", lambda x: x != ""))
    whole = rows.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row", "c"))).alias("r"))
    caption = _among(boxes, told, table).select(*table, F.col("caption") if "caption" in boxes.columns else F.lit(None).cast("string").alias("caption"))
    whole = whole.withColumn("rows", F.transform("r", lambda x: x["c"])).drop("r").join(caption, table, "left")
    return placed, whole.select(*table, "caption", "rows", table_markdown(F.col("rows"), F.col("caption")).alias("markdown"))


def page_facts(tokens: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, width, height, native)`` plus ``text``, ``mean_conf``, ``low_count``, ``token_count`` of the tokens outside tables,
    ``fallback`` (whether the native text stands in) and ``table_area_ratio``."""
    page = list(ocr.PAGE)
    outside = tokens.filter("table_no is null")
    known = pages.join(ocr.page_stats(outside), page, "left").join(ocr.page_text(outside), page, "left")
    known = known.withColumns(
        {
            "text": F.coalesce("text", F.lit("")), "native": F.coalesce("native", F.lit("")), "mean_conf": F.coalesce("mean_conf", F.lit(0.0)),
            "token_count": F.coalesce("token_count", F.lit(0)), "low_count": F.coalesce("low_count", F.lit(0)),
        }
    )
    best = ocr.best_text(known.withColumn("seen", F.col("text"))).withColumn("fallback", F.col("text") != F.col("seen")).drop("seen")
    areas = boxes.groupBy(*page).agg(F.collect_list(F.struct(*EDGES)).alias("boxes"))
    ratio = ocr.table_area_ratio(F.coalesce("boxes", F.array().cast(areas.schema["boxes"].dataType)), F.col("width"), F.col("height"))
    return best.join(areas, page, "left").withColumn("table_area_ratio", F.bround(ratio, 4)).drop("boxes")


def elements(tokens: DataFrame, pages: DataFrame, boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Elements of documents, page by page: the text outside tables, then the tables by their number. Columns of
    ``page_elements`` plus ``rows``, a table's rows of cells."""
    placed, found = tables(tokens, boxes, cells)
    placed = written(placed, "layout-elements")
    facts = page_facts(placed, boxes, pages)
    lines = page_elements(facts.select("doc_id", "page", "text"))
    text = lines.select("doc_id", "page", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("nth"), "type", "text", "level", "table", F.lit(None).cast("array<array<string>>").alias("rows"))
    rows = found.select(
        "doc_id", "page", F.lit(1).alias("kind"), F.col("table_no").cast("long").alias("nth"), F.lit("table").alias("type"), F.lit("").alias("text"),
        F.lit(None).cast("int").alias("level"), F.col("markdown").alias("table"), "rows",
    )
    order = Window.partitionBy("doc_id").orderBy("page", "kind", "nth")
    both = text.unionByName(rows).withColumn("pos", F.row_number().over(order) - 1)
    return both.select("doc_id", "pos", "type", "text", "level", "page", "table", "rows")


def extracted(files: DataFrame, extract: Callable[[bytes], dict[str, list[tuple]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """``extract`` on the content of each of ``files(doc_id, content)``, in the tasks: (tokens, pages, boxes and cells by name,
    ``(doc_id, _error)`` of the files in which it failed). It returns a dict of lists of tuples in the order of TOKENS,
    PAGES, BOXES and CELLS, each of which may be missing. What it returns is written once."""
    names = {k: [c.split()[0] for c in v.split(", ")] for k, v in PARTS.items()}
    schema = "doc_id string, _error string, " + ", ".join(f"{k} array<struct<{v.replace(' ', ':').replace(',:', ',')}>>" for k, v in PARTS.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in batch.itertuples(index=False):
                row = {"doc_id": doc, "_error": None} | {k: None for k in PARTS}
                try:
                    got = extract(bytes(content))
                    row |= {k: [dict(zip(names[k], t, strict=True)) for t in got.get(k, [])] for k in PARTS}
                except Exception as e:  # noqa: BLE001  a bad file is reported and skipped
                    row["_error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([row])

    found = written(files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, schema), "extracted")
    good = found.filter("_error is null")
    parts = {k: good.select("doc_id", F.explode(k).alias("x")).select("doc_id", "x.*") for k in PARTS}
    return parts, found.filter("_error is not null").select("doc_id", "_error")
