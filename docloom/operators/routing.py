"""Routes of questions by rules, and what is done with models' replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import contains_any, json_body, strip

ADVANCED, BASIC, SIMPLE = "advanced_rag", "basic_rag", "simple"


def _decision(route: str, reason: str, *techniques: str) -> Column:
    listed = F.array(*map(F.lit, techniques)) if techniques else F.array().cast("array<string>")
    return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"), listed.alias("techniques"))


def by_rules(question: Column) -> Column:
    """``struct(route, reason, techniques)``; null where no rule fits."""
    flat = F.regexp_replace(strip(question), r"\s+", " ")
    lower = F.lower(flat)
    several = contains_any(flat, X.MULTI_PART) | contains_any(lower, X.MULTI_PART)
    exception = contains_any(lower, X.CONDITIONAL) & contains_any(lower, X.EXCEPTION)
    return (
        F.when(several, _decision(ADVANCED, "several needs in one question", "decomposition", "compression"))
        .when(exception, _decision(ADVANCED, "a condition with an exception", "rewriting", "reranking", "crag"))
        .when(contains_any(lower, X.DOCUMENT_SENSITIVE), _decision(BASIC, "a fact that documents define"))
    )


def fallback(question: Column) -> Column:
    """The decision without a model."""
    q = F.lower(question)
    words = F.size(F.regexp_extract_all(question, F.lit(r"[^\s\x{A0}]+"), F.lit(0)))
    return (
        F.when(contains_any(q, X.FALLBACK_COMPARE), _decision(ADVANCED, "a comparison, or more than one part", "decomposition", "compression"))
        .when(contains_any(q, X.FALLBACK_DATE), _decision(ADVANCED, "a date or another limit on documents", "self_query"))
        .when(contains_any(q, X.FALLBACK_VAGUE), _decision(ADVANCED, "wording that leaves the subject open", "rewriting"))
        .when((words <= 7) & contains_any(q, X.FALLBACK_FOCUSED), _decision(BASIC, "short, about one fact"))
        .otherwise(_decision(BASIC, "nothing else applies"))
    )


def route(question: Column, reply: Column | None = None) -> Column:
    """Rules first, then a model's reply if there is a usable one, then the fallback."""
    rules = by_rules(question)
    if reply is None:
        return F.coalesce(rules, fallback(question))
    return F.coalesce(rules, from_reply(reply), fallback(question))


def from_reply(reply: Column) -> Column:
    """A router model's JSON: unknown routes become basic, unknown techniques go."""
    got = F.from_json(json_body(reply), "route string, reason string, techniques array<string>")
    known = F.filter(F.coalesce(got["techniques"], F.array().cast("array<string>")), lambda t: t.isin(*X.TECHNIQUES))
    route_ = F.when(got["route"].isin(SIMPLE, BASIC, ADVANCED), got["route"]).otherwise(BASIC)
    return F.when(
        json_body(reply).isNotNull(),
        F.struct(route_.alias("route"), F.coalesce(got["reason"], F.lit("")).alias("reason"), known.alias("techniques")),
    )


def rewritten(reply: Column, question: Column, key: str = "query") -> Column:
    """One wording from a model's JSON; blank or unusable ones give the question."""
    got = strip(F.get_json_object(json_body(reply), f"$.{key}"))
    return F.when(F.coalesce(got, F.lit("")) != "", got).otherwise(question)


def several(reply: Column, key: str = "queries", limit: int = 3) -> Column:
    """Several wordings from a model's JSON, without blanks; nothing if it is no list."""
    got = F.from_json(F.get_json_object(json_body(reply), f"$.{key}"), "array<string>")
    clean = F.filter(F.transform(got, strip), lambda q: F.coalesce(q, F.lit("")) != "")
    return F.coalesce(F.slice(clean, 1, limit), F.array().cast("array<string>"))


def filters(reply: Column) -> Column:
    """The metadata filter in a model's JSON, as a map: known fields only, without nulls and
    empties, years as whole numbers."""
    raw = F.from_json(json_body(reply), "map<string,string>")
    clean = F.transform_values(
        raw,
        lambda k, v: F.when(k.isin(*X.YEAR_FIELDS), strip(v).try_cast("int").cast("string")).otherwise(strip(v)),
    )
    return F.map_filter(clean, lambda k, v: k.isin(*X.FILTER_FIELDS) & v.isNotNull() & (v != ""))
