import random

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, layout, ocr

TOKENS = "doc_id string, " + layout.TOKENS
BOXES = "doc_id string, " + layout.BOXES
CELLS = "doc_id string, " + layout.CELLS
PAGES = "doc_id string, " + layout.PAGES


def test_tokens_in_boxes_equal_brute_force(spark):
    r = random.Random(1)
    boxes = []
    for page in range(4):
        for n in range(30):
            x, y, w, h = r.uniform(-50, 900), r.uniform(-50, 900), r.choice([3, 40, 64, 300, 5000]), r.choice([2, 64, 128, 900])
            boxes.append(("d", page, n, x, y, x + w, y + h, None))
    boxes += [("d", 0, 50, 10.0, 10.0, 10.0, 90.0, None), ("d", 0, 51, None, 0.0, 9.0, 9.0, None), ("d", 0, 52, float("nan"), 0.0, 9.0, 9.0, None), ("e", 9, 0, 0.0, 0.0, 64.0, 64.0, None)]
    tokens = []
    for i in range(1500):
        x, y = r.uniform(-100, 1000), r.uniform(-100, 1000)
        tokens.append(("d", i % 5, 0, 0, 0, i, "w", "90", x, y, x + 4, y + 2))
    tokens += [("e", 9, 0, 0, 0, 1, "w", "9", 60.0, 62.0, 68.0, 66.0), ("e", 9, 0, 0, 0, 2, "w", "9", 60.0, 62.0, 68.1, 66.0), ("e", 9, 0, 0, 0, 3, "w", "9", None, 1.0, 2.0, 2.0), ("e", 8, 0, 0, 0, 4, "w", "9", 1.0, 1.0, 2.0, 2.0)]
    got = layout.held(spark.createDataFrame(tokens, TOKENS).repartition(4), spark.createDataFrame(boxes, BOXES), ["doc_id", "page"], "table_no").collect()
    want = {}
    for t in tokens:
        hits = [b[2] for b in boxes if t[8] is not None and b[:2] == t[:2] and b[3] is not None and b[3] < b[5] and b[4] < b[6] and b[3] <= (t[8] + t[10]) / 2 <= b[5] and b[4] <= (t[9] + t[11]) / 2 <= b[6]]
        want[t[0], t[1], t[5]] = min(hits, default=None)
    assert {(x.doc_id, x.page, x.word_num): x.table_no for x in got} == want and len(got) == len(tokens)
    assert sum(v is not None for v in want.values()) > 300


@pytest.mark.parametrize("order", [[10, 13, 16], [13, 10, 16], [16, 10, 13], [10, 13, 16, 7], [7, 16, 12]])
def test_rows_of_cells_follow_the_order_of_cells(spark, order):
    cells = [("d", 1, 1, i, float(50 - i), float(top), f"{top}") for i, top in enumerate(order)]
    rows: list[list] = []
    for c in cells:  # first fit, as by hand
        row = next((r for r in rows if abs(r[0][5] - c[5]) <= 4), None)
        rows.append([c]) if row is None else row.append(c)
    rows.sort(key=lambda r: min(c[5] for c in r))
    want = {c[6]: (i, j) for i, r in enumerate(rows) for j, c in enumerate(sorted(r, key=lambda c: c[4]))}
    for parts in (1, 3):
        df = spark.createDataFrame(list(reversed(cells)), "doc_id string, page int, table_no int, cell_no int, x0 double, top double, text string").repartition(parts, "text")
        assert {r.text: (r.row, r.col) for r in ocr.cell_rows(df).collect()} == want


class Extractor:
    """Of contents like ``page|x,y word ...`` lines; tables are given as ``box`` and ``cell`` lines."""

    def extract(self, content: bytes):
        out = {"tokens": [], "pages": [], "boxes": [], "cells": []}
        for i, line in enumerate(content.decode().split("\n")):
            kind, *rest = line.split("|")
            if kind == "page":
                out["pages"].append((int(rest[0]), 1000.0, 500.0, rest[1] if len(rest) > 1 else None))
            elif kind == "box":
                p, n, *edges = rest
                out["boxes"].append((int(p), int(n), *map(float, edges), None))
            elif kind == "cell":
                p, n, k, *edges = rest
                out["cells"].append((int(p), int(n), int(k), *map(float, edges)))
            else:
                p, x, y, word = rest
                out["tokens"].append((int(p), 1, 1, i // 4, i, word, "90", float(x), float(y), float(x) + 2, float(y) + 2))
        return out


GOOD = "\n".join(
    ["page|1", "page|2|Native text of a page without tokens, long enough.", "page|3"]
    + [f"t|1|{10 + 9 * i}|20|{w}" for i, w in enumerate("Outside words that make a page of text here".split())]
    + ["box|1|2|500|100|700|200", "cell|1|2|1|600|100|700|150", "cell|1|2|0|500|101|600|150", "cell|1|2|2|500|150|600|200", "cell|1|2|3|600|150|700|200"]
    + ["t|1|510|120|Left", "t|1|610|120|Right", "t|1|620|130|side", "t|1|650|170|under", "box|1|1|0|300|100|400", "cell|1|1|0|0|300|100|400", "t|3|5|5|stray"]
)


def test_pages_with_tables_give_elements_in_order(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(GOOD.encode())
    (tmp_path / "b.pdf").write_bytes(b"broken")
    rows = files.read_folder(spark, str(tmp_path), extractor=Extractor()).collect()
    bad = [r for r in rows if r["_error"]]
    assert len(bad) == 1 and bad[0].type is None and "ValueError" in bad[0]["_error"]
    good = sorted((r for r in rows if not r["_error"]), key=lambda r: r.pos)
    assert [(r.pos, r.page, r.type) for r in good] == [(0, 1, "paragraph"), (1, 1, "table"), (2, 2, "paragraph"), (3, 3, "paragraph")]
    assert "Outside words that make a page of text here" == good[0].text.replace("\n", " ") and "Left" not in good[0].text
    assert good[1].table == "| Left | Right side |\n| --- | --- |\n|  | under |"
    assert good[2].text.startswith("Native text") and good[3].text == "stray"


def test_facts_of_pages_and_empty_tables(spark):
    e = Extractor()
    got = e.extract(GOOD.encode())
    t, p, b, c = (spark.createDataFrame([("d", *x) for x in got[k]], s) for k, s in (("tokens", TOKENS), ("pages", PAGES), ("boxes", BOXES), ("cells", CELLS)))
    placed, found = layout.tables(t, b, c)
    facts = {r.page: r for r in layout.page_facts(placed, b, p).collect()}
    assert facts[1].table_area_ratio == round((200 * 100 + 100 * 100) / 500_000, 4) and facts[1].token_count == 9
    assert [facts[i].fallback for i in (1, 2, 3)] == [False, True, False] and facts[2].token_count == 0
    assert [r.rows for r in found.collect()] == [[["Left", "Right side"], ["", "under"]]]
    none = layout.elements(t.limit(0), p.limit(0), b.limit(0), c.limit(0))
    assert none.count() == 0
    assert layout.elements(t, p, b.limit(0), c.limit(0)).filter("type = 'table'").count() == 0
    assert layout.extracted(spark.createDataFrame([], "doc_id string, content binary"), e.extract)[1].count() == 0
    assert layout.held(t.withColumn("table_no", F.lit(7)), b, ["doc_id", "page"], "table_no").filter("table_no = 7").count() == 0


def test_pages_with_many_boxes_go_by_the_grid(spark, monkeypatch):
    r = random.Random(5)
    boxes = [("d", p, n, x := r.uniform(0, 500), y := r.uniform(0, 500), x + 90, y + 40, None) for p in range(6) for n in range(3 + 10 * (p % 2))]
    tokens = spark.createDataFrame([("d", i % 7, 0, 0, 0, i, "w", "90", r.uniform(0, 500), y := r.uniform(0, 500), 510.0, y) for i in range(900)], TOKENS)
    of = lambda: {x.word_num: x.table_no for x in layout.held(tokens, spark.createDataFrame(boxes, BOXES), ["doc_id", "page"], "table_no").collect()}
    lists = of()
    monkeypatch.setattr(layout, "FEW", 5)
    assert of() == lists and len(lists) == 900 and len(set(lists.values())) > 5


def test_boxes_and_cells_without_tokens_are_not_written(spark, monkeypatch):
    """A hundred pages have tables, one has tokens."""
    boxes = spark.createDataFrame([("d", p, n, 0.0, 50.0 * n, 90.0, 50.0 * n + 40, None) for p in range(100) for n in range(4)], BOXES)
    cells = spark.createDataFrame([("d", p, n, c, 45.0 * c, 50.0 * n, 45.0 * c + 45, 50.0 * n + 40) for p in range(100) for n in range(4) for c in range(2)], CELLS)
    tokens = spark.createDataFrame([("d", 7, 0, 0, 0, i, "word", "90", 10.0, 60.0, 12.0, 62.0) for i in range(3)] + [("d", 200, 0, 0, 0, 9, "word", "90", 10.0, 60.0, 12.0, 62.0)], TOKENS)
    written, rows = layout.written, []

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(layout, "written", counted)
    placed, found = layout.tables(tokens, boxes, cells)
    assert [(r.page, r.table_no, r.rows) for r in found.collect()] == [(7, 1, [["word word word", ""]])]
    assert sorted(((r.page, r.table_no) for r in placed.collect()), key=lambda x: x[0]) == [(7, 1)] * 3 + [(200, None)]
    assert sum(rows) < 30
