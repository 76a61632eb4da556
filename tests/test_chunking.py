import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunking as C
from docloom.operators import elements as E

SCHEMA = "doc_id long, pos int, type string, text string, level int, page int, table string"


def made(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SCHEMA)


def p(text, page=None):
    return ("paragraph", text, None, page, None)


def h(text, level, page=None):
    return ("heading", text, level, page, None)


def t(md, page=None):
    return ("table", "", None, page, md)


@pytest.mark.parametrize("n", [0, 1, 40, 41, 79, 80, 200, 333])
def test_fixed_windows_cover_the_text(spark, n):
    text = "".join(random.Random(n).choice("abc") for _ in range(n))
    rows = C.fixed_size(spark.createDataFrame([(1, text)], "doc_id long, text string"), 40, 10).orderBy("position").collect()
    want = [] if not n else [(s, min(s + 40, n)) for s in range(0, max(1, n - 10), 30) if s == 0 or s + 10 < n]
    assert [(r.char_start, r.char_end) for r in rows] == want
    assert [r.text for r in rows] == [text[a:b] for a, b in want]


def test_blank_windows_take_no_position(spark):
    rows = C.fixed_size(spark.createDataFrame([(1, "a" * 10 + " " * 25 + "b" * 5)], "doc_id long, text string"), 10, 0).collect()
    assert sorted((r.position, r.text) for r in rows) == [(0, "a" * 10), (1, "b" * 5)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n?،", max_size=300), st.integers(5, 60))
def test_recursive_pieces_hold_all_characters(text, size):
    pieces = C.split_text(text, size, 1)
    joined = "".join(pieces).replace(" ", "").replace("\n", "")
    assert len(joined) >= len(text.replace(" ", "").replace("\n", "")) or not pieces
    if len(text) <= size:
        assert pieces == ([text] if text.strip() else [])


def test_recursive_rules():
    # put together at four levels, each of which takes one character along
    assert C.split_text("aa. bb. cc", 5, 1) == ["aa. ", "    bb. ", "    cc"]
    assert C._joined(iter(["abcde", "fghij", "kl"]), 5, 0) == ["abcde", "abcdefghij", "abcdefghijkl"]
    assert C.split_text("   ", 5, 1) == [] and C.split_text("abc", 5, 1) == ["abc"]


def test_table_pieces():
    md = "| h |\n| --- |\n" + "\n".join(f"| {'r' * 10}{i} |" for i in range(4))
    pieces = C.split_table(md, 45, "c")
    assert all(x.startswith("**Table: c**\n\n| h |\n| --- |") for x in pieces)
    assert "".join(pieces).count("rrrrrrrrrr") == 4
    assert C.split_table("| h |\n| --- |", 5) == ["| h |\n| --- |"]


def test_sections(spark):
    rows = made(spark, p("pre"), h("A", 1), h("empty", 2), h("B", 2), p("b"), h("C", 4), p("c"), h("D", 3), p("d"), h("E", 1), p("e"))
    got = [(r.text, r.section) for r in E.section_paths(rows).orderBy("pos").collect()]
    assert got == [("pre", ""), ("b", "A > B"), ("c", "A > B > C"), ("d", "A > B > D"), ("e", "E")]


def test_structural_puts_text_before_tables(spark):
    rows = made(spark, h("A", 1), t("| x |\n| --- |", 1), p("one", 1), p("two", 2), t("| y |\n| --- |", 2))
    got = [(r.chunk_type, r.section, r.page, r.text) for r in C.structural(rows).orderBy("position").collect()]
    assert got == [
        ("text", "A", 1, "A\n\none"),
        ("table", "A", 1, "| x |\n| --- |"),
        ("text", "A", 2, "A\n\ntwo"),
        ("table", "A", 2, "| y |\n| --- |"),
    ]


def test_segments_end_at_pages_and_tables(spark):
    rows = made(spark, p("a"), p("b", 1), p("c", 1), p("d", 2), t("| x |", 2), p("e"))
    got = [(r.chunk_type, r.text, r.page) for r in C.segments(rows).orderBy("pos").collect()]
    assert got == [("text", "a\n\nb\n\nc", 1), ("text", "d", 2), ("table", "| x |", 2), ("text", "e", None)]


def test_procedures(spark):
    rows = made(
        spark, p("intro", 1), t("| ملحق |\n| --- |", 1), p("more", 2), p("Procedure 1: go\nthere", 3), p("step"), t("| z |\n| --- |", 3), p("1. task ends", 4)
    )
    got = [(r.chunk_type, r.section, r.page, r.text) for r in C.procedures(rows).orderBy("position").collect()]
    title, appendix = "Procedure 1: go\nthere", "الملاحق"
    assert got == [
        ("text", appendix, 1, f"{appendix}\n\nintro"),
        ("table", appendix, 1, f"{appendix}\n\n| ملحق |\n| --- |"),
        ("text", appendix, 2, f"{appendix}\n\nmore"),
        ("text", title, 3, f"{title}\n\nstep"),
        ("table", title, 3, f"{title}\n\n| z |\n| --- |"),
        ("text", "1. task ends", 4, "1. task ends"),
    ]


def test_parents_and_children(spark):
    rows = made(spark, p("Process 7: long " + "word " * 400))
    got = C.parent_child(rows, 900, 300, 40).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got))) and len({r.parent_id for r in got}) > 1
    for r in got:
        assert 0 <= r.child_index < r.child_count and r.text.startswith("Process 7")


def test_bad_sizes_are_errors():
    for f in (lambda: C.check(5, 5), lambda: C.splitter(0, 0), lambda: C.chunk(None, "other")):
        with pytest.raises(ValueError):
            f()


def test_markdown(spark):
    md = "# T\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 |\n| 2 | 3 |\nafter\n| no | table |\n###### six\n| x |\n| y |\n| - |\n|--|\n| z |"
    got = E.markdown_elements(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.type, r.text, r.level) for r in got] == [
        ("heading", "T", 1),
        ("paragraph", "text\nmore", None),
        ("table", "", None),
        ("paragraph", "after\n| no | table |", None),
        ("heading", "six", 6),
        ("paragraph", "| x |\n| y |", None),
        ("table", "", None),
    ]
    assert got[2].table == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |" and got[6].table == "| - |\n| --- |\n| z |"


def test_page_headings(spark):
    text = "إجراءات الصرف\nline one\nline two\n\n3. Numbered heading\nقسم المخزون\nplain"
    got = E.page_elements(spark.createDataFrame([(1, 4, text)], "doc_id long, page int, text string")).orderBy("pos").collect()
    assert [(r.type, r.text, r.level) for r in got] == [
        ("heading", "إجراءات الصرف", 2),
        ("paragraph", "line one\nline two", None),
        ("heading", "3. Numbered heading", 3),
        ("heading", "قسم المخزون", 3),
        ("paragraph", "plain", None),
    ]


def test_full_text(spark):
    rows = made(spark, h("A", 2), p("x"), t("| t |"))
    assert E.full_text(rows).first().full_text == "## A\n\nx\n\n| t |"
    assert E.text_elements(spark.createDataFrame([(1, " a \n \n\n b\nc ")], "doc_id long, text string")).select(F.collect_list("text")).first()[0] == ["a", "b\nc"]


def test_cells_with_line_ends_stay_whole():
    md = "| a | b |\n| --- | --- |\n| x\ny | 1 |\n| z | 2 |"
    assert C.split_table(md, 30) == ["| a | b |\n| --- | --- |\n| x\ny | 1 |", "| a | b |\n| --- | --- |\n| z | 2 |"]
