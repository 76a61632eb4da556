"""The three metadata filters. They differ on purpose; see each.

``metadata`` is a map of strings, ``wanted`` a plain dict of what a question asks for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip, years

_TEXT = ("document", "procedure", "section", "version", "department")
_DATES = ("issue_date", "review_date")
_YEARS = ("issue_year", "review_year")
_YEAR_SOURCES = ("year", "publication_year", *_YEARS, *_DATES)


def _lower_keys(metadata: Column) -> Column:
    return F.transform_keys(metadata, lambda k, _: F.lower(k))


def _holds(actual: Column, expected: object) -> Column:
    return F.coalesce(F.lower(strip(actual)).contains(str(expected).strip().lower()), F.lit(False))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any_year_after(metadata: Column, threshold: int) -> tuple[Column, Column]:
    """(is there any year, is one later than the threshold) over all fields with dates."""
    found = F.flatten(F.array(*(F.coalesce(years(metadata[k]), F.array().cast("array<int>")) for k in _YEAR_SOURCES)))
    return F.size(found) > 0, F.exists(found, lambda y: y > threshold)


def store_filter(metadata: Column, wanted: Mapping[str, object]) -> Column:
    """Of the vector store: substrings without regard to case; a year matches if it is among those
    of the field, or else of the date; what is missing does not match."""
    m = _lower_keys(metadata)
    tests = [_holds(m[k], wanted[k]) for k in (*_TEXT, *_DATES) if wanted.get(k) is not None]
    for k in _YEARS:
        if wanted.get(k) is not None:
            source = F.coalesce(m[k], m[k.replace("_year", "_date")])
            tests.append(F.coalesce(F.array_contains(years(source), int(wanted[k])), F.lit(False)))
    if wanted.get("year_gt") is not None:
        tests.append(F.coalesce(_any_year_after(m, int(wanted["year_gt"]))[1], F.lit(False)))
    return _all(tests)


def keyword_filter(metadata: Column, wanted: Mapping[str, object]) -> Column:
    """Of the keyword index: equal, or one of a list; years as numbers; ``year_gt`` compares the
    later of issue and review year; keys as they are."""
    tests = []
    number = lambda k: strip(metadata[k]).try_cast("int")
    for k, expected in wanted.items():
        if expected is None:
            continue
        if k in _YEARS:
            test = number(k) == int(expected)
        elif k == "year_gt":
            test = F.greatest(number("issue_year"), number("review_year")) > int(expected)
        elif isinstance(expected, (list, tuple, set)):
            test = metadata[k].isin([str(x) for x in expected])
        else:
            test = metadata[k] == str(expected)
        tests.append(F.coalesce(test, F.lit(False)))
    return _all(tests)


def engine_filter(metadata: Column, wanted: Mapping[str, object], section: Column, source: Column, text: Column) -> Column:
    """Of the engine: as the store's, but a chunk's own section and source stand in for missing
    metadata, years compare as numbers (the date's first year stands in), and ``year_gt`` falls
    back to years in source and text."""
    m = _lower_keys(metadata)
    own = {"section": section, "document": source}
    tests = [
        _holds(F.coalesce(m[k], own[k]) if k in own else m[k], wanted[k])
        for k in (*_TEXT, *_DATES)
        if wanted.get(k) is not None
    ]
    for k in _YEARS:
        if wanted.get(k) is not None:
            first = F.get(years(m[k.replace("_year", "_date")]), 0)
            actual = F.when(m[k].isNotNull(), strip(m[k]).try_cast("int")).otherwise(first)
            tests.append(F.coalesce(actual == int(wanted[k]), F.lit(False)))
    if wanted.get("year_gt") is not None:
        known, later = _any_year_after(m, int(wanted["year_gt"]))
        spare = years(F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(text, F.lit(""))))
        fallback = F.exists(spare, lambda y: y > int(wanted["year_gt"]))
        tests.append(F.coalesce(F.when(known, later).otherwise(fallback), F.lit(False)))
    return _all(tests)
