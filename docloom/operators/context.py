"""Budgeted context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

BUDGET = 12_000

SYSTEM_PROMPT = (
    "Answer from the supplied context alone. Cite each fact as [Source N]. Keep different reports, "
    "procedures and roles apart. Say so if the context is not enough or contradicts itself."
)
USER_START = "<context>\n"
USER_MIDDLE = "\n</context>\n\n<question>\n"
USER_END = "\n</question>\n\nGive the shortest complete answer that the context supports, with [Source N] citations."


def first_of_each(hits: DataFrame) -> DataFrame:
    """The best-ranked hit of each chunk of a question, ranked anew."""
    own = Window.partitionBy("qid", "chunk_id").orderBy("rank")
    order = Window.partitionBy("qid").orderBy("rank", "chunk_id")
    kept = hits.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(order))


def _four_places(x: Column) -> Column:
    return F.regexp_replace(F.format_number(F.bround(x, 4), 4), ",", "")


def blocks(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``hits(qid, chunk_id, rank, score, chunk_type, text, source, page, section)`` to the blocks that
    fit: ``(qid, index, chunk_id, block)``. The first block over the budget ends the context; only if
    it is the very first is it cut to fit, where more than its head and 20 characters remain."""
    rows = first_of_each(hits)
    file = F.regexp_extract(F.coalesce("source", F.lit("")), r"([^/\\]*)$", 1)
    head = F.concat(
        F.format_string("[Source %d | TYPE=%s | FILE=%s", F.col("rank"), F.when(F.col("chunk_type") == "table", "TABLE").otherwise("TEXT"), file),
        F.coalesce(F.concat(F.lit(" | PAGE="), F.col("page").cast("string")), F.lit("")),
        F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" | SECTION="), F.col("section"))).otherwise(""),
        F.concat(F.lit(" | SCORE="), _four_places(F.col("score")), F.lit("]")),
    )
    body = F.when(
        F.col("chunk_type") == "table", F.concat(F.lit("TABLE CONTENT:\n"), "text", F.lit("\n\n" + X.TABLE_NOTE))
    ).otherwise(F.concat(F.lit("TEXT CONTENT:\n"), "text"))
    rows = rows.withColumns({"head": head}).withColumn("block", F.concat("head", F.lit("\n"), body))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(F.length("block")).over(upto))
    fits = F.col("upto") <= budget
    cut = (F.col("rank") == 1) & ~fits & (F.length("head") + 20 < budget)
    return rows.filter(fits | cut).select(
        "qid",
        F.col("rank").alias("index"),
        "chunk_id",
        "chunk_type",
        "source",
        "page",
        "section",
        "score",
        F.when(fits, F.col("block")).otherwise(F.substring("block", 1, budget)).alias("block"),
    )


def build(questions: DataFrame, hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(qid, context, sources)`` of every question; empty without hits."""
    taken = blocks(hits, budget).groupBy("qid").agg(
        F.array_sort(
            F.collect_list(F.struct("index", "chunk_id", "chunk_type", "source", "page", "section", "score", "block"))
        ).alias("all")
    )
    context = F.array_join(F.transform("all", lambda x: x["block"]), X.BLOCK_SEPARATOR)
    sources = F.transform("all", lambda x: x.dropFields("block"))
    return (
        questions.select("qid")
        .distinct()
        .join(taken.select("qid", context.alias("context"), sources.alias("sources")), "qid", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
    )


def prompt(question: Column, context: Column) -> Column:
    shown = F.when(context.rlike(r"\S"), context).otherwise(X.NO_CONTEXT)
    return F.concat(F.lit(USER_START), shown, F.lit(USER_MIDDLE), question, F.lit(USER_END))


def messages(rows: DataFrame, history: str | None = None) -> DataFrame:
    """``rows(qid, question, context)`` with ``system`` and ``messages``, earlier turns first."""
    own = F.array(F.struct(F.lit("user").alias("role"), prompt(F.col("question"), F.col("context")).alias("content")))
    all_ = own if history is None else F.concat(F.coalesce(F.col(history), F.array().cast(rows.schema[history].dataType)), own)
    return rows.withColumns({"system": F.lit(SYSTEM_PROMPT), "messages": all_})


TURN_RANGE = 1024  # numbers of turns that share a partial sum


def turn_positions(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, text, ...)`` plus ``start``, where a turn begins if all turns of its conversation stand one after
    the other, and ``size``, its characters and one more. The sums run in two steps, within ranges of turns and over the
    ranges' totals, so a conversation may hold any share of the rows."""
    rows = turns.withColumns({"size": (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long"), "part": F.floor(F.col("turn") / TURN_RANGE)})
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(F.sum("size").alias("total"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("total").over(ahead), F.lit(0))).drop("total")
    within = Window.partitionBy("conv_id", "part").orderBy("turn", F.xxhash64("role", "text")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0))
    out = rows.withColumn("before", before).join(sums, ["conv_id", "part"])
    return out.withColumn("start", F.col("ahead") + F.col("before")).drop("part", "ahead", "before")


def recent_history(turns: DataFrame, budget: int) -> DataFrame:
    """``turns(conv_id, turn, role, text)``: each user turn with the last turns before it, in order, as many whole turns as fit
    ``budget`` characters (a turn counts its characters and one). Turns meet by ranges of ``budget`` characters in their
    conversation, so the work grows with the turns and what they are given, not with the square of a conversation.

    Null texts are empty ones; a null conversation has no history; a turn longer than the budget is in no history, and nothing
    before it is; a conversation's turns are told apart by ``turn``."""
    placed = turn_positions(turns.filter("conv_id is not null"))
    range_ = lambda c: F.floor(c / budget)
    asks = placed.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "start")
    near = asks.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), range_(F.col("start") - budget)), range_(F.col("start")))))
    old = placed.select(F.col("conv_id"), range_(F.col("start")).alias("r"), F.col("start").alias("at"), F.struct("role", F.col("text").alias("content")).alias("m"))
    met = near.select("conv_id", "turn", "start", "r").join(old, ["conv_id", "r"]).filter((F.col("at") < F.col("start")) & (F.col("at") >= F.col("start") - budget))
    told = met.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("all"))
    told = told.select("conv_id", "turn", F.transform("all", lambda x: x["m"]).alias("history"))
    none = F.array().cast(told.schema["history"].dataType)
    return asks.drop("start").join(told, ["conv_id", "turn"], "left").withColumn("history", F.coalesce("history", none))


def with_history(prompt_: Column, history: Column) -> Column:
    """A prompt after the turns before it, for models that take one text."""
    lines = F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return F.when(F.size(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), prompt_)).otherwise(prompt_)


def chat_history(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)``: each user turn with the turns before it, in order."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before))
    return rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "history")
