"""Reranking, confidence, the corrective check and compression.

Candidates are ``(qid, chunk_id, rank, score, text, chunk_type, variants)``: variants are the
wordings to score against, the question first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import contains_any, overlap_share, sigmoid, strip, word_set
from .hooks import LexicalScorer, PairScorer

CANDIDATES = 15


def variants(question: Column, wordings: Column, subquestion: Column | None = None) -> Column:
    """Up to five distinct wordings: the sub-question if any, the question, the others."""
    first = F.array(question) if subquestion is None else F.array(subquestion, question)
    every = F.transform(F.concat(first, F.coalesce(wordings, F.array().cast("array<string>"))), strip)
    return F.slice(F.array_distinct(F.filter(every, lambda q: F.coalesce(q, F.lit("")) != "")), 1, 5)


def _shared(terms: tuple[str, ...], variants_: Column, text: Column) -> Column:
    """How many terms both a variant and the text hold."""
    asked = F.lower(F.array_join(variants_, "\n"))
    return sum((F.when(asked.contains(t) & text.contains(t), 1).otherwise(0) for t in terms[1:]),
               F.when(asked.contains(terms[0]) & text.contains(terms[0]), 1).otherwise(0))


def features(candidates: DataFrame, scorer: PairScorer | None = None) -> DataFrame:
    """The parts of a candidate's score, and ``new_score``.

    The count of wordings that found a hit is its own (``n_found``).
    """
    scorer = scorer or LexicalScorer()
    text = F.lower(F.coalesce("text", F.lit("")))
    pairs = candidates.withColumn("logits", F.transform("variants", lambda v: scorer.logit(v, F.col("text"))))
    pairs = pairs.withColumns(
        {
            "pair_logit": F.array_max("logits"),
            "best_query": F.element_at("variants", F.array_position("logits", F.array_max("logits")).cast("int")),
            "pair": F.round(sigmoid(F.array_max("logits")), 9),
            "lexical": F.round(
                F.array_max(F.transform("variants", lambda v: overlap_share(word_set(v), word_set(text)))), 9
            ),
        }
    )
    bonus = X.BONUS
    out = pairs.withColumns(
        {
            "table_bonus": F.when(F.col("chunk_type") == "table", bonus["table"]).otherwise(0.0),
            "formula_bonus": F.when(text.rlike(X.FORMULA) | contains_any(text, X.FORMULA_TERMS), bonus["formula"]).otherwise(0.0),
            "keyword_bonus": F.least(
                F.lit(bonus["keyword_max"]), _shared(X.RERANK_TERMS, F.col("variants"), text) * bonus["keyword_step"]
            ),
            "phrase_bonus": F.least(
                F.lit(bonus["keyword_max"]), _shared(X.RERANK_PHRASES, F.col("variants"), text) * bonus["phrase"]
            ),
            "retrieval": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 10.0)),
            "multi_bonus": F.least(
                F.lit(bonus["multi_max"]), F.greatest(F.lit(0), F.col("n_found") - 1) * bonus["multi_step"]
            ),
        }
    )
    w = X.RERANK_WEIGHTS
    score = w["pair"] * F.col("pair") + w["retrieval"] * F.col("retrieval") + w["lexical"] * F.col("lexical")
    for k in ("table_bonus", "formula_bonus", "keyword_bonus", "phrase_bonus", "multi_bonus"):
        score = score + F.col(k)
    return out.withColumn("new_score", F.bround(score, 6))


def rerank(candidates: DataFrame, top_k: int = 5, limit: int = CANDIDATES, scorer: PairScorer | None = None) -> DataFrame:
    """The first ``max(top_k, limit)`` candidates scored anew, of which ``max(5, top_k)`` stay. The
    cut stands before the scorer, which sees no other rows."""
    first = candidates.filter(F.col("rank") <= max(top_k, limit))
    order = Window.partitionBy("qid").orderBy(F.desc("new_score"), "rank", "chunk_id")
    scored = features(first, scorer).withColumn("new_rank", F.row_number().over(order))
    return scored.filter(F.col("new_rank") <= max(5, top_k))


def _of_rank(rank: str, value: Column, n: int) -> Column:
    return F.max(F.when(F.col(rank) == n, value))


def confidence(questions: DataFrame, hits: DataFrame, rank: str = "new_rank", pair: str | None = "pair") -> DataFrame:
    """Of each question: top score, mean of three, margin to the second, and their weighted sum.
    Scores are the scorer's features, or hit scores cut to [0, 1]. No hits give 0."""
    value = F.col(pair) if pair else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    near = F.col(rank) <= 3
    facts = hits.groupBy("qid").agg(
        F.count("*").alias("n"),
        _of_rank(rank, value, 1).alias("top"),
        _of_rank(rank, value, 2).alias("second"),
        F.avg(F.when(near, value)).alias("average"),
        F.count_if((F.col(rank) <= 5) & (F.col("chunk_type") == "table")).alias("tables"),
        F.count_if((F.col(rank) <= 5) & contains_any(F.col("text"), X.EVIDENCE_TERMS)).alias("formulas"),
    )
    w = X.CONFIDENCE_WEIGHTS
    margin = F.when(F.col("second").isNull(), F.col("top")).otherwise(
        F.when(F.col("top") > F.col("second"), F.col("top") - F.col("second")).otherwise(0.0)
    )
    raw = (
        w["top"] * F.col("top")
        + (w["average"] + w["agreement"]) * F.col("average")
        + w["margin"] * F.least(F.lit(1.0), margin * 5.0)
    )
    rows = questions.select("qid").distinct().join(facts, "qid", "left").withColumns(
        {"margin": margin, "raw": F.when(F.col("n") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 9))}
    )
    zero = lambda c: F.coalesce(F.bround(c, 3), F.lit(0.0))
    label = F.when(F.col("raw") >= X.CONFIDENCE_LABELS[0][0], X.CONFIDENCE_LABELS[0][1])
    for least, name in X.CONFIDENCE_LABELS[1:]:
        label = label.when(F.col("raw") >= least, name)
    share = lambda c, n: F.bround(F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / n), 3)
    return rows.select(
        "qid",
        zero(F.col("raw")).alias("confidence"),
        label.otherwise("Very Low").alias("label"),
        zero(F.col("top")).alias("top_score"),
        zero(F.col("average")).alias("average_top_score"),
        zero(F.col("margin")).alias("margin"),
        zero(F.col("average")).alias("agreement"),
        share("formulas", 2).alias("formula_evidence"),
        share("tables", 3).alias("table_evidence"),
        F.least(F.lit(5), F.coalesce("n", F.lit(0))).cast("int").alias("evidence_count"),
    )


def corrective_check(questions: DataFrame, hits: DataFrame, rank: str = "new_rank", pair: str | None = "pair") -> DataFrame:
    """Whether the first five hits suit the question. Without a scorer's feature the share of the
    question's words in a hit decides, with lower thresholds."""
    low, high = (0.40, 0.55) if pair else (0.05, 0.15)
    own = questions.select("qid", F.col("text").alias("question"))
    five = hits.filter(F.col(rank) <= 5).join(own, "qid")
    value = F.col(pair) if pair else overlap_share(word_set(F.col("question")), word_set(F.col("text")))
    mean = five.groupBy("qid").agg(F.round(F.avg(value), 9).alias("mean"))
    rows = own.select("qid").distinct().join(mean, "qid", "left")
    decision = F.when(F.coalesce(F.col("mean"), F.lit(0.0)) < low, "not_relevant").when(F.col("mean") < high, "uncertain").otherwise("relevant")
    return rows.select(
        "qid",
        decision.alias("decision"),
        F.when(decision == "relevant", "keep").otherwise("rewrite").alias("action"),
        F.coalesce(F.bround("mean", 3), F.lit(0.0)).alias("score"),
        F.when(F.col("mean").isNull(), "none").otherwise("cross_encoder_feature" if pair else "lexical_fallback").alias("metric"),
    )


SENTENCE = r"(?<=[.!?؟])\s+|\n"


def compress(hits: DataFrame) -> DataFrame:
    """``hits(qid, chunk_id, chunk_type, text, queries)`` with ``compressed``: sentences that share
    a word with any query, and their neighbours; all of a table, or of a text without such a
    sentence."""
    keys = ["qid", "chunk_id"]
    asked = F.array_distinct(F.flatten(F.transform("queries", word_set)))
    rows = hits.filter("chunk_type <> 'table'").select(*keys, asked.alias("asked"), F.posexplode(F.split("text", SENTENCE)).alias("at", "raw"))
    rows = rows.withColumn("sentence", strip(F.col("raw"))).filter("sentence <> ''")
    order = Window.partitionBy(*keys).orderBy("at")
    hit = F.arrays_overlap(word_set(F.col("sentence")), F.col("asked"))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    near = F.col("hit") | F.coalesce(F.lag("hit").over(order), F.lit(False)) | F.coalesce(F.lead("hit").over(order), F.lit(False))
    kept = (
        rows.withColumn("near", near)
        .filter("near")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("kept"))
        .select(*keys, F.array_join(F.transform("kept", lambda x: x["sentence"]), " ").alias("short"))
    )
    return hits.join(kept, keys, "left").withColumn("compressed", F.coalesce("short", "text")).drop("short")


def compression_stats(compressed: DataFrame) -> DataFrame:
    sums = compressed.groupBy("qid").agg(
        F.sum(F.length("text")).alias("chars_before"), F.sum(F.length("compressed")).alias("chars_after")
    )
    return sums.withColumn("chars_removed", F.col("chars_before") - F.col("chars_after"))
