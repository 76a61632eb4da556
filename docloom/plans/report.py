"""Reports of runs: what each question took, means by pipeline, route and technique, counts of an ingest.

Defined cases: an answer that is null (its call failed) has null metrics and no tokens, its question is counted all the same; a null
reference leaves ``correctness`` null; means are over the values that are there, null where there are none; a question without techniques stands
under ``(none)``; one with several stands under each, and once in every other total; an empty run has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, chunking, embed, evaluation, hooks, routing
from ..operators.written import written
from ..sources import files

METRICS = ("context_relevance", "faithfulness", "answer_relevance", "correctness")
AMOUNTS = ("confidence", "n_sources", "n_calls", "input_tokens", "output_tokens", "cost", "latency")
LEVELS = {"all": [], "pipeline": ["pipeline"], "route": ["pipeline", "route"], "technique": ["pipeline", "technique"]}
NO_TECHNIQUE = "(none)"
_EXACT = "decimal(28,10)"


def answer_calls(answers: DataFrame, model: str = "") -> DataFrame:
    """The last call of each question: as the log has it (``answer_call``), else with tokens as the stand-in counts them."""
    step = F.when(F.col("route") == routing.SIMPLE, "direct_generation").otherwise("final_generation")
    if "answer_call" in answers.columns:
        return calls.call_rows(answers, "answer", step)
    asked, given = hooks.mock_usage(F.col("prompt"), F.col("answer"))
    none = F.lit(None)
    return answers.filter("answer is not null").select(
        "qid", step.alias("step"), F.lit(model).alias("model"), asked.alias("input_tokens"), given.alias("output_tokens"), none.cast("double").alias("latency"), none.cast("string").alias("error")
    )


def measured(answers: DataFrame, pipeline: str, model: str = "", more_calls: DataFrame | None = None, judge: str | None = None) -> DataFrame:
    """A row for each question of ``answers``, which ``pipelines.answer`` or ``baseline`` made: metrics, tokens and cost.

    ``more_calls(qid, step, model, input_tokens, output_tokens, latency, error)`` are calls before the last one (router, wordings). ``answers``
    are written first: they are read three times, and no model is to be called three times.
    """
    some = {
        "route": F.lit(routing.BASIC), "techniques": F.array().cast("array<string>"), "confidence": F.lit(None).cast("double"), "reference": F.lit(None).cast("string"),
        "sources": F.lit(None).cast("array<string>"),
    }
    rows = answers.withColumns({c: v for c, v in some.items() if c not in answers.columns})
    rows = rows.withColumns({"question": F.col("text"), "n_sources": F.coalesce(F.size("sources"), F.lit(0))})
    keep = ["qid", "question", "answer", "context", "prompt", "route", "techniques", "confidence", "reference", "n_sources"]
    rows = written(rows.select(*keep, *(c for c in ("answer_call", judge) if c and c in rows.columns)), "answers")
    made = answer_calls(rows, model)
    if more_calls is not None:
        made = made.unionByName(more_calls.select(*made.columns))
    spent = evaluation.costs(made).groupBy("qid").agg(
        F.count("*").alias("n_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("cost").cast(_EXACT)).cast("double").alias("cost"),
        F.sum(F.col("latency").cast(_EXACT)).cast("double").alias("latency"),
    )
    judged = evaluation.evaluate(rows, ["qid"], judge)
    values = {m: F.when(F.col("answer").isNotNull(), F.col(m)) for m in METRICS}
    out = judged.withColumns(values).join(spent, "qid", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "input_tokens", "output_tokens")} | {"cost": F.coalesce("cost", F.lit(0.0))}
    return out.withColumns(zero).select(F.lit(pipeline).alias("pipeline"), "qid", "route", "techniques", *METRICS, *AMOUNTS)


def by_levels(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measured``, of any number of pipelines, to ``(level, pipeline, route, technique, metric, n_questions, n, total, mean,
    least, most)``, for all levels in one pass.

    A question has a row for each technique, of which only the first counts where techniques are not told apart. Metrics
    stay columns until the sums are made, so what moves is a row for each group and task, whatever the number of questions.
    Sums are exact (decimals), so they don't depend on the order of rows.
    """
    names = [*METRICS, *AMOUNTS]
    listed = F.when(F.size("techniques") > 0, F.array_distinct("techniques")).otherwise(F.array(F.lit(NO_TECHNIQUE)))
    each = rows.select("pipeline", "route", *names, F.posexplode(listed).alias("place", "technique"))
    first = F.col("place") == 0
    sums = [F.count("*").alias("rows_each"), F.count(F.when(first, 1)).alias("rows_once")]
    for m in names:
        value = F.col(m).cast(_EXACT)
        for kind, v in (("each", value), ("once", F.when(first, value))):
            sums += [F.count(v).alias(f"n_{kind}_{m}"), F.sum(v).alias(f"sum_{kind}_{m}")]
        sums += [F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    keys = ["pipeline", "route", "technique"]
    grouped = each.groupingSets([[F.col(c) for c in s] for s in LEVELS.values()], *keys).agg(*(F.grouping(c).alias(f"without_{c}") for c in keys), *sums)
    told = F.col("without_technique") == 0
    level = F.when(told, "technique").when(F.col("without_route") == 0, "route").when(F.col("without_pipeline") == 0, "pipeline").otherwise("all")
    taken = lambda name, m: F.when(told, F.col(f"{name}_each{m}")).otherwise(F.col(f"{name}_once{m}"))
    one = lambda m: F.struct(
        F.lit(m).alias("metric"), taken("n", f"_{m}").alias("n"), taken("sum", f"_{m}").cast("double").alias("total"),
        F.col(f"min_{m}").cast("double").alias("least"), F.col(f"max_{m}").cast("double").alias("most"),
    )
    out = grouped.select(level.alias("level"), *keys, taken("rows", "").alias("n_questions"), F.explode(F.array(*map(one, names))).alias("m"))
    mean = F.bround(F.round(F.try_divide(F.col("m.total"), F.col("m.n")), 9), 6).alias("mean")
    return out.filter("n_questions > 0").select("level", *keys, "m.metric", "n_questions", "m.n", F.bround("m.total", 6).alias("total"), mean, "m.least", "m.most")


def side_by_side(advanced: DataFrame, basic: DataFrame) -> DataFrame:
    """Two runs of ``measured`` over the same questions, each metric and the cost with the difference."""
    out = evaluation.compare(advanced, basic, ["qid"], [*METRICS])
    costs = [x.select("qid", F.col("cost").alias(f"{name}_cost")) for name, x in (("advanced", advanced), ("basic", basic))]
    return out.join(costs[0], "qid", "left").join(costs[1], "qid", "left").withColumn("delta_cost", F.bround(F.col("advanced_cost") - F.col("basic_cost"), 10))


def _counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict]:
    """``df`` written, and aggregates of its rows that are taken while it is written. They stand in the last stage before the
    files, of which each task counts once, however often it is tried."""
    seen = Observation(name)
    out = written(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, seen.get


def ingest(
    spark: SparkSession, path: str, strategy: str = "parent_child", embedder: embed.Embedder | None = None, extractor: hooks.PageExtractor | None = None
) -> tuple[DataFrame, DataFrame, dict]:
    """``pipelines.ingest`` with a report: (chunks with vectors, errors by file, counts).

    Files are opened once. Counts: files by format (at most one number for each known format), elements, tables, headings, files with an
    error, chunks, their characters. A folder without a known file has counts of 0.
    """
    by_format = {r.format: r.n for r in files.scan(spark, path).groupBy("format").agg(F.count("*").alias("n")).collect()}  # reads no content
    found = files.read_folder(spark, path, extractor=extractor)
    is_a = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    found, seen = _counted(
        found, "elements", elements=F.count(F.when(F.col("_error").isNull(), 1)), tables=is_a("table"), headings=is_a("heading"), errors=F.count("_error")
    )
    chunks = chunking.chunk(found.filter("_error is null"), strategy)
    chunks, cut = _counted(chunks, "chunks", chunks=F.count("*"), chars=F.coalesce(F.sum(F.length("text")), F.lit(0)))
    vectors = embed.choose("auto", embedder).embed(chunks, ["chunk_id"], "text", "vector")
    errors = found.filter("_error is not null").select("doc_id", "_error")
    return chunks.join(vectors, "chunk_id"), errors, {"files": by_format} | seen | cut
