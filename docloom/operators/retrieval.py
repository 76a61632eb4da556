"""Retrieval for many questions at once: vectors, BM25, fusion and merging.

``questions(qid, query_idx, text)`` holds a row for each wording of a question; hits are
``(qid, query_idx, chunk_id, score, rank)``. Scores are rounded to six places before they are
ranked, so that equal ones stay equal whatever the order of their sums; ``chunk_id`` breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, tokens
from . import scan
from .vectors import PLACES, cosine_topk  # noqa: F401  part of this module's interface
from .written import written

K1, B, EPSILON = 1.5, 0.75, 0.25
BROADCAST_ROWS = 200_000  # smaller sides are sent to all executors up to this many rows


def usable(questions: DataFrame, top_k: int) -> DataFrame:
    """Without blank questions; none at all for a top_k below 1."""
    return questions.filter(F.lit(top_k > 0) & ~blank(F.coalesce("text", F.lit(""))))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if counting finds it within ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def met(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """``chunks`` joined with written ``hits`` by chunk_id: up to BROADCAST_ROWS hits go to the chunks, which then don't move."""
    return chunks.join(small(hits), "chunk_id")


def ranked(scored: DataFrame, top_k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


# --- BM25 ---------------------------------------------------------------------------------


def _begun(chunks: DataFrame) -> tuple[DataFrame, Column]:
    """Chunks with their sorted tokens (``found``) and where a term begins among them; and the terms with their counts."""
    found = chunks.select("chunk_id", F.sort_array(tokens(F.col("text"))).alias("found")).filter(F.size("found") > 0)
    begins = lambda i: (i == 0) | (F.get("found", i) != F.get("found", i - 1))
    begun = found.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("found") - 1), begins))
    after = lambda j: F.coalesce(F.get("at", j + 1), F.size("found"))
    return begun, F.transform("at", lambda i, j: F.struct(F.get("found", i).alias("term"), (after(j) - i).cast("long").alias("tf")))


def term_runs(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, dl, runs)``: dl is the number of a chunk's tokens, ``runs`` an array of its terms with their counts,
    by term; chunk_id is unique. A chunk's sorted tokens are counted by their runs where the chunk lies, so no row moves."""
    begun, runs = _begun(chunks)
    return begun.select("chunk_id", F.size("found").cast("long").alias("dl"), runs.alias("runs"))


def postings(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, dl, term, tf)``, a row for each of a chunk's ``term_runs``."""
    begun, runs = _begun(chunks)
    # exploded as an expression: of a column Spark would infer that it isn't empty, and work it out again for that
    rows = begun.select("chunk_id", F.size("found").cast("long").alias("dl"), F.explode(runs).alias("run"))
    return rows.select("chunk_id", "dl", "run.term", "run.tf")


def index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms with df and idf, one row of corpus totals), each written once: pass them to
    several searches of the same chunks.

    idf is ln(N - df + 0.5) - ln(df + 0.5); where that is negative, EPSILON times the mean over all
    terms. Chunks without a term count for N and the mean length.
    """
    post = written(postings(chunks), "postings")
    totals = written(chunks.agg(F.count("*").alias("n")).crossJoin(post.agg(F.sum("tf").alias("words"))), "totals")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = written(df.crossJoin(F.broadcast(totals)).withColumn("raw", raw), "terms")  # totals is one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    terms = idf.crossJoin(F.broadcast(mean)).select(
        "term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )
    return post, terms, totals


def _asked(questions: DataFrame, top_k: int) -> DataFrame:
    terms = usable(questions, top_k).select("qid", "query_idx", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("qid", "query_idx", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(questions: DataFrame, chunks: DataFrame, top_k: int, made: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(qid, query_idx, chunk_id, score)`` of all chunks that share a term with a question."""
    post, terms, totals = made or index(chunks)
    wanted = written(_asked(questions, top_k).join(terms, "term"), "asked")
    found = post.join(small(wanted), "term").crossJoin(F.broadcast(totals))
    length = 1 - B + B * F.col("dl") * F.col("n") / F.col("words")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return found.groupBy("qid", "query_idx", "chunk_id").agg(F.bround(F.sum(part), PLACES).alias("score"))


def bm25(questions: DataFrame, chunks: DataFrame, top_k: int, made: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Top-k chunks of each ``(qid, query_idx)`` that share a term with it; a term that a question
    repeats counts as often. ``made``: the chunks' ``index``, if there is one; without it a block of questions is sent to the
    texts (``scan``), and only for more of them an index is made."""
    found = None if made else scan.bm25(_asked(questions, top_k), chunks, top_k, K1, B, EPSILON, PLACES)
    if found is not None:
        return ranked(found, top_k, "qid", "query_idx")
    return ranked(bm25_scores(questions, chunks, top_k, made), top_k, "qid", "query_idx")


# --- fusion -------------------------------------------------------------------------------


def _both(semantic: DataFrame, keyword: DataFrame, *more: str) -> DataFrame:
    keys = ["qid", "query_idx", "chunk_id"]
    of = lambda hits, kind: hits.select(*keys, *(F.col(c).alias(f"{kind}_{c}") for c in ("score", "rank", *more)))
    return of(semantic, "semantic").join(of(keyword, "keyword"), keys, "full")


def _ordered(fused: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid", "query_idx").orderBy(
        F.desc("score"), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), "chunk_id"
    )
    out = fused.withColumns(
        {
            "score": F.bround("score", 9),
            "in_semantic": F.col("semantic_rank").isNotNull(),
            "in_keyword": F.col("keyword_rank").isNotNull(),
        }
    )
    return out.withColumn("rank", F.row_number().over(order))


def rrf(semantic: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists that have the chunk."""
    k = max(1, k)
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return _ordered(_both(semantic, keyword).withColumn("score", part("semantic_rank") + part("keyword_rank")))


def minmax(hits: DataFrame) -> DataFrame:
    """Adds ``norm``: the score between the least (0) and greatest (1) of its question."""
    own = Window.partitionBy("qid", "query_idx")
    low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    return hits.withColumn("norm", F.when(span == 0, F.lit(0.0)).otherwise((F.col("score") - low) / span))


def weighted(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * the normalised semantic score + (1 - alpha) * the keyword one."""
    a = min(1.0, max(0.0, alpha))
    both = _both(minmax(semantic), minmax(keyword), "norm")  # the norms come along, so each side is searched once
    part = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.lit(a) * part("semantic_norm") + F.lit(1.0 - a) * part("keyword_norm")
    return _ordered(both.withColumn("score", score).drop("semantic_norm", "keyword_norm"))


def fuse(semantic: DataFrame, keyword: DataFrame, method: str = "rrf", alpha: float = 0.5, k: int = 60) -> DataFrame:
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {method!r}")
    return rrf(semantic, keyword, k) if method == "rrf" else weighted(semantic, keyword, alpha)


def cut(fused: DataFrame, top_k: int) -> DataFrame:
    """The first top_k of each question's fused hits, ranked anew."""
    order = Window.partitionBy("qid", "query_idx").orderBy("rank")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def hybrid(semantic: DataFrame, keyword: DataFrame, top_k: int, method: str = "rrf", alpha: float = 0.5, k: int = 60, keep: Column | None = None) -> DataFrame:
    """Fused hits up to top_k. ``keep``, a condition on the hits, applies after fusion and before
    the cut, so it can leave fewer."""
    fused = fuse(semantic, keyword, method, alpha, k)
    return cut(fused if keep is None else fused.filter(keep), top_k)


def fetch_depth(top_k: int) -> int:
    return max(40, top_k)


# --- many wordings ------------------------------------------------------------------------


def wordings(questions: DataFrame, generated: str) -> DataFrame:
    """``questions(qid, text)`` with an array column of generated wordings to a row for each
    distinct one, the question first."""
    both = F.array_distinct(F.concat(F.array("text"), F.coalesce(F.col(generated), F.array().cast("array<string>"))))
    rows = questions.select("qid", F.posexplode(both).alias("query_idx", "text"))
    return rows.filter(~blank(F.coalesce("text", F.lit(""))))


def merge(hits: DataFrame, top_k: int = 20, listed: bool = False) -> DataFrame:
    """One hit for each chunk of a question: the best score (the earlier wording wins a tie), all
    wordings that found it in order, and all scores. ``listed`` repeats the first score, as merging
    lists that carry their scores does."""
    seen = F.array_sort(F.collect_list(F.struct("query_idx", "rank", "score")))
    best = F.max_by(F.struct("score", "query_idx"), F.struct(F.col("score"), -F.col("query_idx"), -F.col("rank")))
    rows = hits.groupBy("qid", "chunk_id").agg(best.alias("best"), seen.alias("seen"))
    scores = F.transform("seen", lambda x: x["score"])
    if listed:
        scores = F.concat(F.slice(scores, 1, 1), scores)
    out = rows.select(
        "qid",
        "chunk_id",
        F.col("best.score").alias("score"),
        F.col("best.query_idx").alias("best_query"),
        F.array_distinct(F.transform("seen", lambda x: x["query_idx"])).alias("queries"),
        scores.alias("scores"),
        F.struct(F.col("seen")[0]["query_idx"], F.col("seen")[0]["rank"]).alias("first"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("first")


def merge_decomposed(hits: DataFrame, top_k: int = 20) -> DataFrame:
    """``merge`` of lists of which each was found for a sub-question (query_idx 1, 2, ...) or for the question itself (0, which
    comes last). The first list that has a chunk tags it: ``sub_index`` is its sub-question, null for the question itself.
    Lists bring their scores along, so the first score stands twice; a later list wins only with a higher score."""
    place = F.when(F.col("query_idx") == 0, F.lit(1 << 30)).otherwise(F.col("query_idx")).cast("int")
    rows = hits.withColumn("place", place)
    seen = F.array_sort(F.collect_list(F.struct("place", "rank", "score", "query_idx")))
    best = F.max_by(F.struct("score", "query_idx"), F.struct(F.col("score"), -F.col("place"), -F.col("rank")))
    found = rows.groupBy("qid", "chunk_id").agg(best.alias("best"), seen.alias("seen"))
    first = F.col("seen")[0]
    scores = F.transform("seen", lambda x: x["score"])
    out = found.select(
        "qid",
        "chunk_id",
        F.col("best.score").alias("score"),
        F.col("best.query_idx").alias("best_query"),
        F.array_distinct(F.transform("seen", lambda x: x["query_idx"])).alias("queries"),
        F.concat(F.slice(scores, 1, 1), scores).alias("scores"),
        F.when(first["query_idx"] > 0, first["query_idx"]).alias("sub_index"),
        F.struct(first["place"], first["rank"]).alias("first"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("first")


def query_stats(hits: DataFrame, chunks: DataFrame, preview: int = 500) -> DataFrame:
    """Of each wording: how many hits, the best five scores and the start of their chunks. Hits are written, for they are read twice."""
    hits = written(hits, "hits")
    top = met(chunks.select("chunk_id", F.substring("text", 1, preview).alias("preview")), hits.filter("rank <= 5"))
    five = top.groupBy("qid", "query_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.bround("score", 6).alias("score"), "chunk_id", "preview"))).alias("five")
    )
    counts = hits.groupBy("qid", "query_idx").agg(F.count("*").alias("result_count"))
    take = lambda k: F.transform("five", lambda x: x[k])
    return counts.join(five, ["qid", "query_idx"]).select(
        "qid", "query_idx", "result_count", take("score").alias("top_scores"), take("chunk_id").alias("top_chunks"), take("preview").alias("previews")
    )
