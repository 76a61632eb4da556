"""What is done with recognised tokens of scanned pages.

``tokens(doc_id, page, block_num, par_num, line_num, word_num, text, conf)``, conf as a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import strip

PAGE = ("doc_id", "page")


def normalize(text: Column) -> Column:
    """Without marks of direction and byte order; blanks and blank lines one at a time."""
    out = F.translate(F.translate(F.coalesce(text, F.lit("")), "\ufeff\u200e\u200f", ""), "\u00a0", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n[ \t]*\n[ \t]*\n+", "\n\n")
    return strip(out)


def remove_noise(text: Column) -> Column:
    """Without lines that have no letter or digit, and without a line that repeats the last one that
    stayed (blank lines between them don't count); one blank line at a time."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), X.LINE_END), strip)
    kept = F.filter(lines, lambda x: (x == "") | x.rlike(f"[{X.ARABIC}A-Za-z0-9]"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(s: Column, x: Column) -> Column:
        gap = (F.size(s["out"]) > 0) & (F.element_at(s["out"], -1) != "")
        add = F.when(x == "", gap).otherwise(x != s["last"])
        return F.struct(
            F.when(add, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"),
            F.when(x == "", s["last"]).otherwise(x).alias("last"),
        )

    return strip(F.aggregate(kept, start, step, lambda s: F.array_join(s["out"], "\n")))


def page_stats(tokens: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Mean confidence, short tokens below 25, and tokens that are not blank."""
    score = strip(F.col("conf")).try_cast("double")
    word = strip(F.coalesce("text", F.lit("")))
    good = score.isNotNull() & (word != "")
    return tokens.groupBy(*keys).agg(
        F.coalesce(F.bround(F.avg(F.when(good, score)), 6), F.lit(0.0)).alias("mean_conf"),
        F.count_if(good & (score < 25) & (F.length(word) <= 4)).alias("low_count"),
        F.count_if(good).alias("token_count"),
    )


def page_text(tokens: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Lines again, without short tokens below 20 that are not Arabic; then cleaned."""
    word = strip(F.coalesce("text", F.lit("")))
    conf = F.coalesce(strip(F.col("conf")).try_cast("double"), F.lit(-1.0))
    noise = (conf < 20) & (F.length(word) <= 4) & ~word.rlike(f"[{X.ARABIC}]")
    rows = tokens.withColumn("word", word).filter((F.col("word") != "") & ~noise)
    lines = rows.groupBy(*keys, "block_num", "par_num", "line_num").agg(
        F.array_sort(F.collect_list(F.struct("word_num", "word"))).alias("w")
    )
    lines = lines.withColumn("line", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    pages = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "line"))).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return pages.select(*keys, remove_noise(normalize(text)).alias("text"))


def is_weak(text: Column, mean_conf: Column, token_count: Column) -> Column:
    """Whether a page's recognised text should not be trusted."""
    arabic = F.regexp_count(text, F.lit(f"[{X.ARABIC}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    solid = F.length(F.regexp_replace(text, rf"{X.SPACE}+", ""))
    return (token_count == 0) | (solid < 20) | ((arabic == 0) & (latin == 0)) | ((mean_conf < 18) & (arabic < 30))


def best_text(pages: DataFrame) -> DataFrame:
    """``pages(..., text, mean_conf, token_count, native)``: the native text where recognition is weak
    and the native text is longer."""
    native = normalize(F.col("native"))
    weak = is_weak(F.col("text"), F.col("mean_conf"), F.col("token_count"))
    return pages.withColumn("text", F.when(weak & (F.length(native) > F.length("text")), native).otherwise(F.col("text")))


def table_area_ratio(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page that its tables' boxes (x0, top, x1, bottom) cover, 1 at most."""
    area = F.aggregate(
        boxes,
        F.lit(0.0),
        lambda s, b: s + F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["bottom"] - b["top"]),
    )
    return F.when(width * height > 0, F.least(F.lit(1.0), area / (width * height))).otherwise(F.lit(0.0))


def cell_rows(cells: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``cells(doc_id, page, table_no, cell_no, x0, top, text)`` with ``row`` and ``col``. In the order of ``cell_no`` a cell joins
    the first row whose first cell's top is within ``tolerance``, or starts a row; rows are put in order by their least top,
    cells by x0, what ties by the order of cells. Without a ``cell_no`` cells are taken by top and x0. A table's cells are
    one group, as small as a page."""

    keys = ["doc_id", "page", "table_no"]
    near = lambda t, top: F.abs(t - top) <= tolerance
    first = ["cell_no"] if "cell_no" in cells.columns else ["top", "x0"]
    rest = [c for c in ("cell_no", "x0", "top", "text") if c in cells.columns and c not in first]
    found = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("cells"))
    tops = F.aggregate(
        F.transform("cells", lambda c: c["top"].cast("double")),
        F.array().cast("array<double>"),
        lambda seen, top: F.when(F.exists(seen, lambda t: near(t, top)), seen).otherwise(F.concat(seen, F.array(top))),
    )
    each = found.withColumn("tops", tops).select(*keys, "tops", F.posexplode("cells").alias("at", "cell")).select(*keys, "tops", "at", "cell.*")
    each = each.withColumn("made", F.array_position(F.transform("tops", lambda t: near(t, F.col("top"))), True))
    of = Window.partitionBy(*keys, "made")
    each = each.withColumn("least", F.min("top").over(of)).withColumn("col", F.row_number().over(of.orderBy("x0", "at")).cast("long") - 1)
    each = each.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("least", "made")).cast("long") - 1)
    return each.select(*cells.columns, "row", "col")
