"""Metrics of answers by word overlap, and reports of what calls cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import evaluation_tokens

SENTENCE = r"(?<=[.!?؟])\s+"


def _share(asked: Column, given: Column, weight: float) -> Column:
    both = F.size(F.array_intersect(asked, given))
    return F.least(F.lit(1.0), both / F.greatest(F.lit(1.0), F.size(asked) * F.lit(weight)))


def relevance(asked: Column, given: Column, weight: float) -> Column:
    return F.bround(_share(evaluation_tokens(asked), evaluation_tokens(given), weight), 3)


def faithfulness(answers: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., faithfulness)``: the mean over an answer's sentences of the share of their words
    that the context has; 0 without a sentence. ``answers(keys..., answer, context)``."""
    rows = answers.select(*keys, evaluation_tokens(F.col("context")).alias("c"), F.explode(F.split("answer", SENTENCE)).alias("s"))
    rows = rows.filter(F.col("s").rlike(r"[^\s\x{A0}]")).withColumn("w", evaluation_tokens(F.col("s")))
    cited = F.lower("s").contains("[source") & (F.size("w") > 3)
    value = F.when(cited, _share(F.col("w"), F.col("c"), 0.45)).otherwise(_share(F.col("w"), F.col("c"), 0.55))
    return rows.groupBy(*keys).agg(F.bround(F.round(F.avg(value), 9), 3).alias("faithfulness"))


def f1(answer: Column, reference: Column) -> Column:
    """Of the two sets of words; null without a reference."""
    a, r = evaluation_tokens(answer), evaluation_tokens(reference)
    both = F.size(F.array_intersect(a, r))
    total = F.size(a) + F.size(r)
    return F.when(F.coalesce(reference, F.lit("")) != "", F.when(both > 0, F.bround(F.round(2 * both / total, 9), 3)).otherwise(0.0))


def evaluate(answers: DataFrame, keys: list[str], judge: str | None = None) -> DataFrame:
    """``answers(keys..., question, answer, context, route, reference)`` with the four metrics.

    Without a context the first two are 1 for simple questions, else 0. ``judge`` names a column of
    structs with a model's values, which win where they are present."""
    blank = F.coalesce("context", F.lit("")) == ""
    plain = F.when(F.col("route") == "simple", 1.0).otherwise(0.0)
    faith = faithfulness(answers.filter(~blank), keys)
    out = answers.join(faith, keys, "left").withColumns(
        {
            "context_relevance": F.when(blank, plain).otherwise(relevance(F.col("question"), F.col("context"), 0.45)),
            "faithfulness": F.when(blank, plain).otherwise(F.coalesce("faithfulness", F.lit(0.0))),
            "answer_relevance": relevance(F.col("question"), F.col("answer"), 0.35),
            "correctness": f1(F.col("answer"), F.col("reference")),
        }
    )
    if judge:
        for m in ("context_relevance", "faithfulness", "answer_relevance", "correctness"):
            value = F.coalesce(F.col(judge)[m], F.col(m))
            if m == "correctness":
                value = F.when(F.coalesce("reference", F.lit("")) != "", value)
            out = out.withColumn(m, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3))
    return out


# --- costs --------------------------------------------------------------------------------


def _price_cases(model: Column, prices: list[tuple[str, tuple[float, float]]], default: tuple[float, float]) -> Column:
    pair = lambda p: F.struct(F.lit(p[0]).alias("input"), F.lit(p[1]).alias("output"))
    name = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for key, price in prices:
        hit = name.contains(key)
        out = F.when(hit, pair(price)) if out is None else out.when(hit, pair(price))
    return out.otherwise(pair(default))


def simulated_price(model: Column) -> Column:
    """The longest name that the model's holds."""
    return _price_cases(model, sorted(X.SIMULATED_PRICES.items(), key=lambda p: -len(p[0])), X.SIMULATED_DEFAULT)


def actual_price(model: Column) -> Column:
    """The first name in the list's order that the model's holds."""
    return _price_cases(model, list(X.ACTUAL_PRICES.items()), X.ACTUAL_DEFAULT)


def technique(step: Column) -> Column:
    out = None
    name = F.trim(F.coalesce(step, F.lit("unknown")))
    for k, v in X.STEP_TECHNIQUE.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out.otherwise(name)


def costs(calls: DataFrame) -> DataFrame:
    """``calls(..., model, input_tokens, output_tokens, step)`` with technique and costs in USD."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1_000_000
    out = calls.withColumns({"simulated": simulated_price(F.col("model")), "actual": actual_price(F.col("model"))})
    cost = lambda p: n("input_tokens") * F.col(p)["input"] + n("output_tokens") * F.col(p)["output"]
    return out.withColumns(
        {
            "technique": technique(F.col("step")),
            "input_cost": F.bround(n("input_tokens") * F.col("simulated")["input"], 10),
            "output_cost": F.bround(n("output_tokens") * F.col("simulated")["output"], 10),
            "cost": F.bround(cost("simulated"), 10),
            "actual_cost": F.bround(cost("actual"), 10),
        }
    ).drop("simulated", "actual")


def by_technique(calls: DataFrame) -> DataFrame:
    """Sums by technique and, as technique null, in total."""
    return calls.rollup("technique").agg(
        F.count("*").alias("n_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.bround(F.sum(F.col("cost").cast("decimal(28,10)")).cast("double"), 8).alias("cost"),
    )


def compare(advanced: DataFrame, basic: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Two pipelines side by side with the differences."""
    a = advanced.select(*keys, *(F.col(m).alias(f"advanced_{m}") for m in metrics))
    b = basic.select(*keys, *(F.col(m).alias(f"basic_{m}") for m in metrics))
    out = a.join(b, keys, "full")
    return out.withColumns({f"delta_{m}": F.bround(F.col(f"advanced_{m}") - F.col(f"basic_{m}"), 3) for m in metrics})


def latest_calls(calls: DataFrame) -> DataFrame:
    """Sums of a question's calls, as its call log shows them."""
    return calls.groupBy("qid").agg(F.count("*").alias("n_calls"), F.bround(F.sum(F.col("actual_cost").cast("decimal(28,10)")).cast("double"), 8).alias("total_cost"))


