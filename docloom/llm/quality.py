"""Line-first cleaning with SQL functions only.

Lines are judged first. A line with a word fails if

* punctuation: over 15 % of its characters in words are symbols or exclamation marks, or it has
  fewer than 10 words and ends without a mark that ends or joins sentences and is no heading or
  list item (which start with ``#``, ``-``, ``*`` or a number);
* navigation: it is made of three or more short entries between ``|``, ``>``, ``»``, ``·`` or
  ``•``, or is but a navigation phrase;
* boilerplate: it has fewer than 40 words and holds a phrase of a page's frame (cookies, copyright, scripts, sign-up).

Failing lines are removed. A document is rejected if they hold more than LOST_SHARE of its
characters in words, or if its base statistics fail.

Defined cases: a null or empty text has no words, fails the base and is not kept; lines without
a word are never judged or counted; repeated rows are judged alike; a very long text is judged in whole,
as a row of its own; an empty table gives an empty one; columns named like an output are replaced, others
stay. The phrases of the navigation and boilerplate rules are English; the other rules know no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, guarded

MIN_WORDS = 50
REPEAT_PERCENT = 50
LOST_SHARE = 0.4
SPACES = r"[\x20\x09-\x0D]+"

# Patterns of the line rules, the same for Java and RE2.
NOISE = r"[#*$%&|<>!?@~^=+{}\[\]\\]"
SENTENCE_END = r"[.!?:;,\"')\]…。؟،»”-][\x20\x09-\x0D]*$"
HEADING = r"^[\x20\x09-\x0D]*(#|-|\*|[0-9])"
NAV_PHRASE = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|main menu|next|previous|prev|back|back to top|top|login|log in|sign in|sign up|"
    r"register|search|share|tweet|read more|more|contact|contact us|about|about us|skip to content|"
    r"site map|sitemap|print|comments|reply)[\x20\x09-\x0D.:»>]*$"
)
NAV_ENTRIES = r"^([^|>»·•]{1,25}[|>»·•]){2,}[^|>»·•]{0,25}$"
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright ©|© [0-9]{4}|cookie policy|use of cookies|uses cookies|accept cookies|"
    r"privacy policy|terms of use|terms of service|enable javascript|javascript is (disabled|required)|"
    r"lorem ipsum|subscribe to our|sign up for our|click here to|follow us on|powered by wordpress|"
    r"share this (post|article|page)|leave a comment|page not found)"
)


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def chars_in_words(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def line_fails(line: Column) -> Column:
    noise = F.regexp_count(line, F.lit(NOISE)) * 100 > chars_in_words(line) * 15
    bare = (words_in(line) < 10) & ~line.rlike(SENTENCE_END) & ~line.rlike(HEADING)
    return noise | bare | line.rlike(NAV_PHRASE) | line.rlike(NAV_ENTRIES) | (line.rlike(BOILERPLATE) & (words_in(line) < 40))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Of an array of words, how many lie in three-word windows that occur twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.try_element_at(starts, i + 2) - p, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda p, i: (p["g"] == F.try_element_at(pairs, i + 2)["g"]) | (
            (i > 0) & (p["g"] == F.try_element_at(pairs, F.greatest(i, F.lit(1)))["g"])
        )
        return F.sort_array(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"]))

    def count(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(let(pairs, twice), covered)
        )

    window = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.element_at(words, i + 2), F.element_at(words, i + 3)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(window, count)).cast("long")


@guarded
def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` plus ``__n_words``, ``__word_chars``, ``__n_symbols``,
    ``__n_dup_lines``, ``__n_repeat_words``, ``__lost_chars`` (long), ``__base_failed``,
    ``__kept`` (boolean) and ``__clean``, the text without the lines that fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: x.rlike(WORD)
    out = df.withColumns(
        {
            "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "__lines": F.filter(F.split(text, "\n"), has_word),
            "__word_chars": chars_in_words(text),
            "__n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_repeat_words": repeat_words(F.col("__words")),
            "__bad": F.filter("__lines", line_fails),
        }
    )
    lost = F.aggregate(F.transform("__bad", chars_in_words), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns(
        {
            "__lost_chars": lost,
            "__base_failed": (F.col("__n_words") < MIN_WORDS)
            | (100 * F.col("__n_repeat_words") > REPEAT_PERCENT * F.col("__n_words")),
            "__clean": F.array_join(F.filter("__lines", lambda x: ~line_fails(x)), "\n"),
        }
    )
    kept = ~F.col("__base_failed") & (F.col("__lost_chars") <= F.lit(LOST_SHARE) * F.col("__word_chars"))
    return out.withColumn("__kept", kept).drop("__words", "__lines", "__bad")


def sql(table: str = "documents") -> str:
    """The query's rows in DuckDB's SQL."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    n = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
    chars = lambda x: f"length(regexp_replace({x}, {q(SPACES)}, '', 'g'))"
    fails = (
        f"({n('x', NOISE)} * 100 > {chars('x')} * 15 or ({n('x', WORD)} < 10 and not regexp_matches(x, {q(SENTENCE_END)}) "
        f"and not regexp_matches(x, {q(HEADING)})) or regexp_matches(x, {q(NAV_PHRASE)}) "
        f"or regexp_matches(x, {q(NAV_ENTRIES)}) or (regexp_matches(x, {q(BOILERPLATE)}) and {n('x', WORD)} < 40))"
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from {table}),
w as (select r, unnest(regexp_extract_all(t, {q(WORD)})) as w, generate_subscripts(regexp_extract_all(t, {q(WORD)}), 1) as i from d),
g as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from w window o as (partition by r order by i)),
p as (select r, i from (select r, i, count(*) over (partition by r, g) as k from g where g is not null) where k > 1),
s as (select r, sum(least(3, coalesce(nxt - i, 3))) as rep from (select r, i, lead(i) over (partition by r order by i) as nxt from p) group by r),
l as (select r, doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {q(WORD)})) as lines from d),
a as (select r, doc_id, {n('t', WORD)} as n_words, {chars('t')} as word_chars, {n('t', '[#*$%&|<>]')} as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: {fails}), lambda x: {chars('x')})), 0) as lost from l),
b as (select a.*, coalesce(s.rep, 0) as rep, (n_words < {MIN_WORDS} or 100 * coalesce(s.rep, 0) > {REPEAT_PERCENT} * n_words) as base_failed from a left join s using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, rep::bigint as n_repeat_words, base_failed,
  (not base_failed and lost <= {LOST_SHARE} * word_chars) as kept, lost::bigint as lost_chars from b"""
