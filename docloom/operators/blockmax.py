"""BM25 over postings in blocks: blocks that can't hold a hit are not scored.

Chunks that follow each other by id share a block of 2 ** BLOCK_BITS chunks. The index keeps one row for each term and
block: its postings, packed to a long each (count and place in the block), and the highest part that any of them adds to a
score; ids and lengths of a block's chunks stand once. Summed over a question's
terms these bound every score of the block. So

1. each question's SEEDS blocks of the highest bounds are scored; the k-th best score there is one that its k-th
   hit reaches. The rare terms decide which these are, for they weigh most;
2. of the other blocks only those whose bound reaches it are scored. A frequent term alone seldom does.

The hits are those of ``retrieval.bm25``. Where a term is in every chunk, a question meets one row a block of it,
not one a chunk.

Defined cases are those of ``retrieval.bm25``: blank questions and questions without a known term have no hits,
null texts have no terms; a term whose weight is not positive bounds a score by 0; a question with fewer than k hits in
its first blocks is scored in full; an empty table gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import retrieval
from .retrieval import B, EPSILON, K1, PLACES, small
from .written import written

BLOCK_BITS = 8  # of the number of chunks in a block
PLACE_BITS = 12  # of a posting; BLOCK_BITS may not be more
SEEDS = 4
SLACK = 1e-6  # of scores, for their rounding


def _length(dl: str = "dl") -> Column:
    return 1 - B + B * F.col(dl) * F.col("n") / F.col("words")


def index(chunks: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``chunks(chunk_id, text)`` as (packed postings by term and block, terms, one row of totals, members of blocks), written once.

    A row of the first: ``term``, ``block``, ``top`` (the highest part of a score but for the term's weight), ``n_post`` and
    ``posts``, an array of tf * 2 ** PLACE_BITS + the chunk's place. A row of the last: ``block`` and by place ``ids`` and ``dls``. Chunks are
    put in order of their ids before they are cut into blocks; of a chunk only its terms move.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = retrieval.term_runs(chunks).repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id")
    ordered = written(ordered.withColumn("number", F.monotonically_increasing_id()), "block-runs")
    block, place = F.shiftright("number", block_bits).alias("block"), F.col("number").bitwiseAND((1 << block_bits) - 1)
    totals = written(chunks.agg(F.count("*").alias("n")).crossJoin(ordered.agg(F.sum("dl").alias("words"))), "block-totals")  # one row each
    members = ordered.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("number", "chunk_id", "dl"))).alias("m"))
    members = members.select("block", F.transform("m", lambda x: x["chunk_id"]).alias("ids"), F.transform("m", lambda x: x["dl"]).alias("dls"))
    each = ordered.select(block, place.alias("place"), "dl", F.explode("runs").alias("run")).select("block", "place", "dl", "run.term", "run.tf")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * _length())
    post = F.col("tf") * (1 << PLACE_BITS) + F.col("place")
    # a block's chunks lie in one task, so its postings are packed before they move
    packed = each.crossJoin(F.broadcast(totals)).groupBy("term", "block").agg(F.max(part).alias("top"), F.collect_list(post).alias("posts"))
    packed = written(packed.withColumn("n_post", F.size("posts").cast("long")), "blocks")  # at most 2 ** block_bits postings a row
    df = packed.groupBy("term").agg(F.sum("n_post").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = written(df.crossJoin(F.broadcast(totals)).withColumn("raw", raw), "block-terms")
    mean = terms.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return packed, terms.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), totals, written(members, "block-members")


def _scored(wanted: DataFrame, chosen: DataFrame, packed: DataFrame, totals: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of all chunks in the blocks that are chosen for a question."""
    keys = ["qid", "query_idx"]
    asked = wanted.join(chosen.select(*keys, "block"), keys)
    found = packed.select("term", "block", "posts").join(small(asked), ["term", "block"])
    lengths = members.select("block", "dls")
    each = found.join(lengths, "block").select(*keys, "block", "qtf", "idf", "dls", F.explode("posts").alias("post"))
    each = each.withColumn("place", F.col("post").bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))
    each = each.select(*keys, "block", "place", "qtf", "idf", F.shiftright("post", PLACE_BITS).alias("tf"), F.get("dls", F.col("place")).alias("dl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * _length())
    scores = each.crossJoin(F.broadcast(totals)).groupBy(*keys, "block", "place").agg(F.bround(F.sum(part), PLACES).alias("score"))
    return scores.join(members.select("block", "ids"), "block").select(*keys, F.get("ids", F.col("place")).alias("chunk_id"), "score")


def bm25(
    questions: DataFrame, chunks: DataFrame, top_k: int, made: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None, seeds: int = SEEDS
) -> tuple[DataFrame, DataFrame]:
    """(hits, work): the hits as ``retrieval.bm25`` gives them, and for each question ``blocks`` and ``postings`` that its
    terms have, and how many of them were scored (``blocks_run``, ``postings_run``)."""
    packed, terms, totals, members = made or index(chunks)
    keys = ["qid", "query_idx"]
    asked = (
        retrieval.usable(questions, top_k)
        .select(*keys, F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("qtf"))
    )
    wanted = written(asked.join(terms, "term"), "block-asked")
    most = F.greatest(F.lit(0.0), F.col("qtf") * F.col("idf") * F.col("top"))
    bounds = packed.select("term", "block", "top", "n_post").join(small(wanted), "term")
    bounds = bounds.groupBy(*keys, "block").agg((F.sum(most) + SLACK).alias("bound"), F.sum("n_post").alias("n_post"))
    order = Window.partitionBy(*keys).orderBy(F.desc("bound"), "block")
    bounds = written(bounds.withColumn("nth", F.row_number().over(order)), "block-bounds")
    first = bounds.filter(F.col("nth") <= seeds)
    early = written(_scored(wanted, first, packed, totals, members), "block-scores")
    best = retrieval.ranked(early, top_k, *keys).groupBy(*keys).agg(F.count("*").alias("k"), F.min("score").alias("least"))
    reached = best.filter(F.col("k") >= top_k).select(*keys, "least")
    rest = bounds.filter(F.col("nth") > seeds).join(reached, keys, "left")
    rest = written(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))), "block-rest")
    hits = retrieval.ranked(early.unionByName(_scored(wanted, rest, packed, totals, members)), top_k, *keys)
    run = first.select(*keys, "n_post").unionByName(rest.select(*keys, "n_post")).groupBy(*keys)
    run = run.agg(F.count("*").alias("blocks_run"), F.sum("n_post").alias("postings_run"))
    work = bounds.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum("n_post").alias("postings")).join(run, keys)
    return hits, work
