"""Scalar functions on text, all as Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def strip(text: Column) -> Column:
    """Without white space of any kind (X.SPACE) at both ends. Not by a pattern, which would be tried at each blank within."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\xa0"))


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\x{A0}]")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether one of the terms is a substring. One alternation: the text is read once."""
    escaped = "|".join("".join("\\" + c if c in r"\.[]{}()*+-?^$|=×÷" and c not in "×÷=" else c for c in t) for t in terms)
    return text.rlike(escaped)


def normalize_arabic(text: Column) -> Column:
    """One form of alef, yeh and heh, without diacritics."""
    return F.translate(F.regexp_replace(text, X.DIACRITICS, ""), "إأآىة", "ااايه")


_AR = [
    "".join("ا" if c in "إأآا" else "ي" if c == "ى" else "ه" if c == "ة" else c for c in w) for w in X.STOPWORDS_AR
]
STOPWORDS = sorted({*X.STOPWORDS_EN, *_AR})


def tokens(text: Column) -> Column:
    """The retrieval tokenizer: lower case, Latin and digit runs or Arabic runs in one form, no
    stop words. Texts without Arabic take a path without the work that it needs."""
    lower = F.lower(text)
    latin = F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.transform(
        F.regexp_extract_all(lower, F.lit(X.TOKEN), F.lit(0)),
        lambda t: normalize_arabic(F.regexp_replace(t, X.TOKEN_EDGE, "")),
    )
    found = F.when(lower.rlike(f"[{X.ARABIC_WIDE}]"), F.filter(runs, lambda t: t != "")).otherwise(latin)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def evaluation_tokens(text: Column) -> Column:
    """The evaluator's set of tokens: another normalisation, no stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), X.EVAL_DIACRITICS, "")
    return F.array_distinct(F.regexp_extract_all(F.translate(plain, "أإآى", "اااي"), F.lit(X.EVAL_TOKEN), F.lit(0)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0)))


def years(text: Column) -> Column:
    """Years 1900 to 2099 that stand alone in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(X.YEAR), F.lit(1)), lambda y: y.cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def attribute(attr: Column, metadata: Column, key: str) -> Column:
    """A chunk's own attribute, or else what its metadata has."""
    return F.coalesce(attr.cast("string"), metadata[key])


def overlap_share(part: Column, whole: Column) -> Column:
    """Share of ``part``'s distinct words that ``whole`` has; 0 for no words."""
    n = F.size(part)
    return F.when(n > 0, F.size(F.array_intersect(part, whole)) / n).otherwise(F.lit(0.0))


# --- tables and elements ------------------------------------------------------------------


def table_markdown(rows: Column, caption: Column | None = None) -> Column:
    """Rows of cells as a Markdown table: the first is the header, others get its width."""
    cell = lambda c: F.coalesce(strip(c), F.lit(""))
    width = F.size(rows[0])
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(padded(r)))
    head = F.array(line(F.transform(rows[0], cell)), line(F.array_repeat(F.lit("---"), width)))
    text = F.when(F.size(rows) > 0, F.array_join(F.concat(head, body), "\n")).otherwise(F.lit(""))
    if caption is None:
        return text
    return F.when(F.coalesce(caption, F.lit("")) == "", text).otherwise(
        F.concat(F.lit("**Table: "), caption, F.lit("**\n\n"), text)
    )


def render(kind: Column, text: Column, level: Column, table: Column | None = None) -> Column:
    """An element's text: a table's Markdown, a heading with its marks, or the text itself."""
    heading = F.concat(F.repeat(F.lit("#"), F.when(F.coalesce(level, F.lit(0)) == 0, 1).otherwise(level)), F.lit(" "), text)
    out = F.when(kind == "heading", heading).otherwise(text)
    return out if table is None else F.when(kind == "table", table).otherwise(out)


def between_tags(text: Column, tag: str) -> Column:
    """What stands between a tag and its end; empty without them."""
    a, b = f"<{tag}>", f"</{tag}>"
    i, j = F.locate(a, text), F.locate(b, text)
    return F.when((i > 0) & (j > i), strip(F.substring(text, i + len(a), j - i - len(a)))).otherwise(F.lit(""))


def json_body(text: Column) -> Column:
    """The JSON in a model's reply: without a code fence, else from the first to the last brace."""
    plain = strip(text)
    fenced = F.regexp_replace(F.regexp_replace(plain, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    body = strip(F.when(plain.startswith("```"), fenced).otherwise(plain))
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body).when(braces != "", braces)
