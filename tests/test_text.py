import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, expr, *values, kinds="string"):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds.split())))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("The Quick-brown fox42 and it", ["quick", "brown", "fox42"]),
        ("مُدِيرَةٌ إلى المكتبة، أحمد", ["مديره", "المكتبه", "احمد"]),
        ("ـقلمـ and كتاب؟ x_y", ["قلم", "كتاب", "x", "y"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


def test_evaluation_tokens_keep_teh_marbuta(spark):
    assert sorted(one(spark, T.evaluation_tokens, "مكتبة آدم a_b The the")) == sorted(["مكتبة", "ادم", "a_b", "the"])


def test_words_split_at_marks_and_years_stand_alone(spark):
    assert one(spark, T.word_set, "A b_1 مُد a") == ["a", "b_1", "م", "د"]
    assert one(spark, T.years, "in 1999, 2024-05 and 12024 or 1850") == [1999, 2024]


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.strip, "\n\t  a b \r\n") == "a b"


def test_table_markdown(spark):
    rows = [["h", " k "], ["a"], ["b", None, "extra"]]
    df = spark.createDataFrame([(rows, "cap")], "r array<array<string>>, c string")
    got = df.select(T.table_markdown(F.col("r"), F.col("c")).alias("x")).first().x
    assert got == "**Table: cap**\n\n| h | k |\n| --- | --- |\n| a |  |\n| b |  |"


def test_render_and_tags(spark):
    assert one(spark, T.render, "heading", "t", 0, kinds="string string int") == "# t"
    assert one(spark, T.render, "heading", "t", 3, kinds="string string int") == "### t"
    assert one(spark, T.render, "paragraph", "t", None, kinds="string string int") == "t"
    assert one(spark, lambda c: T.between_tags(c, "q"), "x <q> a b </q> y") == "a b"
    assert one(spark, lambda c: T.between_tags(c, "q"), "</q> <q>") == ""


@pytest.mark.parametrize(
    "reply,want",
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("none", None)],
)
def test_json_body(spark, reply, want):
    assert one(spark, T.json_body, reply) == want


def test_sigmoid_is_clamped(spark):
    assert one(spark, T.sigmoid, 0.0, kinds="double") == 0.5
    assert one(spark, T.sigmoid, -1e9, kinds="double") == pytest.approx(1.9e-22, rel=0.1)
