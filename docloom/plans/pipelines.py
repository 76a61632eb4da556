"""Whole pipelines over batches of questions, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attribute
from ..operators import chunking, context, embed, filtering, hooks, rerank, retrieval, routing, vectors
from ..operators.written import written
from ..sources import files

# Said in place of the instructions on evidence where there is none.
DIRECT_PROMPT = "Answer from general knowledge. Do not refer to documents, for none were given."


def ingest(spark: SparkSession, path: str, strategy: str = "parent_child", embedder: embed.Embedder | None = None, extractor: hooks.PageExtractor | None = None) -> DataFrame:
    """A folder of files to chunks with vectors."""
    elements = files.read_folder(spark, path, extractor=extractor).filter("_error is null")
    chunks = chunking.chunk(elements, strategy)
    vectors = embed.choose("auto", embedder).embed(chunks, ["chunk_id"], "text", "vector")
    return chunks.join(vectors, "chunk_id")


def with_vectors(chunks: DataFrame, embedder: embed.Embedder | None = None) -> DataFrame:
    """``chunks`` with vectors, written once."""
    if "vector" in chunks.columns:
        return chunks
    vectors = embed.choose("auto", embedder).embed(chunks, ["chunk_id"], "text", "vector")
    return chunks.join(written(vectors, "vectors"), "chunk_id")


def retrieve(
    questions: DataFrame, chunks: DataFrame, top_k: int, method: str = "rrf", alpha: float = 0.5, embedder: embed.Embedder | None = None, made: tuple | None = None
) -> DataFrame:
    """Hybrid hits of ``questions(qid, query_idx, text[, wanted])``. ``made``: the chunks' ``retrieval.index``. A filter in
    ``wanted`` is held against the chunks' ``metadata`` after the fusion and before the cut."""
    e = embed.choose("auto", embedder)
    depth = retrieval.fetch_depth(top_k)
    asked = e.embed(retrieval.usable(questions, top_k), ["qid", "query_idx"], "text", "vector", query=True)
    asked = asked.withColumn("query", F.to_json(F.struct("qid", "query_idx")))
    hits = retrieval.cosine_topk(asked, chunks, depth) if "vector" in chunks.columns else vectors.topk_texts(asked, chunks, depth, e)
    found = hits.join(asked.select("query", "qid", "query_idx"), "query")
    keyword = retrieval.bm25(questions, chunks, depth, made)
    if "wanted" in questions.columns and "metadata" in chunks.columns:
        return filtering.hybrid(found, keyword, questions, chunks, top_k, method, alpha)
    return retrieval.hybrid(found, keyword, top_k, method, alpha)


def _attributed(chunks: DataFrame) -> DataFrame:
    own = {c: F.col(c) if c in chunks.columns else F.lit(None).cast("string") for c in ("source", "page", "section")}
    attributes = {c: attribute(v, F.col("metadata"), c) if "metadata" in chunks.columns else v for c, v in own.items()}
    kind = F.col("chunk_type") if "chunk_type" in chunks.columns else F.lit("text")
    return chunks.select("chunk_id", "text", kind.alias("chunk_type"), *(v.alias(k) for k, v in attributes.items()))


REWORDED = ("rewriting", "multi_query", "decomposition", "hyde", "self_query")
HIT = ["qid", "chunk_id", "chunk_type", "text", "source", "page", "section", "queries"]
SUBQUESTIONS = 5


def _worded(routed: DataFrame) -> DataFrame:
    """``routed`` plus what its ``replies`` make of a question: ``generated`` wordings and ``subquestions`` of the techniques that
    it lists, ``wanted``, the filter of a self-query, and ``rewritten``, for a second search."""
    text, reply = F.col("text"), lambda step: F.coalesce(F.col("replies")[step], F.lit(""))
    given = F.coalesce("generated", F.array().cast("array<string>"))
    listed = lambda t: F.array_contains("techniques", t) & (F.col("route") == routing.ADVANCED)
    none = F.array().cast("array<string>")
    has = lambda step: F.col("replies")[step].isNotNull()
    one = lambda step, value: F.when(listed(step) & has(step), value).otherwise(none)
    wordings = F.concat(
        one("rewriting", F.array(routing.rewritten(reply("rewriting"), text))),
        one("multi_query", routing.several(reply("multi_query"))),
        one("hyde", F.array(F.col("replies")["hyde"])),
        one("self_query", F.array(routing.rewritten(reply("self_query"), text, "semantic_query"))),
    )
    spoken = F.col("replies").isNotNull()
    reworded = (F.col("route") == routing.ADVANCED) & F.arrays_overlap("techniques", F.array(*map(F.lit, REWORDED)))
    filters = routing.filters(F.get_json_object(F.coalesce(routing.json_body(reply("self_query")), F.lit("{}")), "$.filters"))
    return routed.withColumns(
        {
            "generated": F.when(spoken, F.filter(wordings, lambda q: F.coalesce(q, F.lit("")) != "")).when(reworded, given),
            "subquestions": F.when(spoken, one("decomposition", routing.several(reply("decomposition"), "subquestions", SUBQUESTIONS))),
            "wanted": F.when(listed("self_query") & has("self_query"), filters),
            "rewritten": F.when(spoken & has("rewriting"), routing.rewritten(reply("rewriting"), text)).when(~spoken, F.get(given, 0)),
        }
    )


def answer(questions: DataFrame, chunks: DataFrame, top_k: int = 5, llm: hooks.LLM | None = None, budget: int = context.BUDGET) -> DataFrame:
    """``questions(qid, text, generated[, replies])`` to routes, evidence and answers, all in one plan. ``chunks`` are read several
    times: pass a table that is written. Their vectors are taken where they have some, else made in each search.

    ``replies`` is a map from a step to a model's reply to it: ``router``, ``rewriting``, ``multi_query``, ``decomposition``, ``hyde`` and
    ``self_query``; where a question has none, ``generated`` holds its wordings, sub-questions or passages, if any. What is done with a
    question follows its route, by rules first, then by the router's reply, and its techniques:

    * simple questions are put to the model as they are, without retrieval;
    * the basic route searches for the question alone and keeps the hits' own order and scores;
    * the advanced route adds the wordings where a technique makes some, and reranks;
    * sub-questions are searched for each, then the question; a hit keeps the first sub-question that found it
      (``retrieval.merge_decomposed``), by which it is reranked too;
    * the filter of a self-query is held against the chunks' ``metadata`` before hits are cut;
    * ``crag`` checks the evidence; where that fails the rewritten question (else the first of ``generated``, else the question) is
      searched for alone, and its reranked hits replace the first ones;
    * ``compression`` shortens the evidence of the questions that list it.

    Confidence is that of the final hits, on both routes. With a column ``history(role, content)``, as ``context.recent_history`` makes
    it, earlier turns stand before the prompt.
    """
    llm = llm or hooks.MockLLM()
    if "replies" in questions.columns:
        decision = routing.route(F.col("text"), F.col("replies")["router"])
    else:
        questions = questions.withColumn("replies", F.lit(None).cast("map<string,string>"))
        decision = routing.route(F.col("text"))
    routed = questions.withColumn("decision", decision).select("*", "decision.*").drop("decision")
    is_advanced = F.col("route") == routing.ADVANCED
    ranked = is_advanced & ~F.array_contains("techniques", "reranking")
    routed = routed.withColumn("techniques", F.when(ranked, F.concat("techniques", F.array(F.lit("reranking")))).otherwise(F.col("techniques")))
    routed = written(_worded(routed), "routed")
    needed = routed.filter(F.col("route") != routing.SIMPLE)
    of = _attributed(chunks)

    def candidates(asked: DataFrame) -> DataFrame:
        """``asked(qid, text, question, generated, subquestions, wanted)`` to merged hits with their texts and wordings."""
        split = F.size(F.coalesce("subquestions", F.array().cast("array<string>"))) > 0
        every = asked.withColumn("generated", F.when(split, F.col("subquestions")).otherwise(F.col("generated")))
        wordings = retrieval.wordings(every, "generated").join(asked.select("qid", "wanted", split.alias("split")), "qid")
        hits = retrieve(wordings.drop("split"), chunks, max(top_k, 8)).join(asked.select("qid", split.alias("split")), "qid")
        hits = written(hits, "hits")  # a few a wording, merged in two ways
        plain = retrieval.merge(hits.filter(~F.col("split")), max(4 * top_k, 20)).withColumn("sub_index", F.lit(None).cast("int"))
        parts = retrieval.merge_decomposed(hits.filter("split")).select(*plain.columns)
        texts = wordings.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("query_idx", "text"))).alias("w"))
        rows = retrieval.met(of, written(plain.unionByName(parts), "merged")).join(texts, "qid").join(asked.select("qid", "question"), "qid")
        found = F.transform("queries", lambda i: F.col("w")[i])
        rows = rows.withColumn("subquestion", F.col("w")[F.col("sub_index")])
        return rows.withColumns({"variants": rerank.variants(F.col("question"), found, F.col("subquestion")), "n_found": F.size("queries"), "queries": found})

    asked = needed.select("qid", "text", F.col("text").alias("question"), "generated", "subquestions", "wanted")
    rows = written(candidates(asked), "candidates")
    on = lambda route: needed.filter(F.col("route") == route)
    basic = rows.join(on(routing.BASIC).select("qid"), "qid", "left_semi").filter(F.col("rank") <= max(top_k, 8))
    advanced = written(rerank.rerank(rows.join(on(routing.ADVANCED).select("qid"), "qid", "left_semi"), top_k), "reranked")

    checked = needed.filter(F.array_contains("techniques", "crag"))
    check = written(rerank.corrective_check(checked, advanced).select("qid", "action"), "checked")
    failed = checked.join(check.filter("action = 'rewrite'").select("qid"), "qid", "left_semi")
    none = F.lit(None).cast("array<string>")
    other = F.coalesce("rewritten", F.col("text"))
    again = failed.select("qid", other.alias("text"), F.col("text").alias("question"), none.alias("generated"), none.alias("subquestions"), "wanted")
    second = rerank.rerank(candidates(again), top_k)
    advanced = advanced.join(failed.select("qid"), "qid", "left_anti").unionByName(second)
    advanced = written(advanced, "evidence")

    facts = rerank.confidence(on(routing.ADVANCED), advanced).unionByName(rerank.confidence(on(routing.BASIC), basic, "rank", None))
    final = advanced.select(*HIT, F.col("new_rank").alias("rank"), F.col("new_score").alias("score")).unionByName(basic.select(*HIT, "rank", "score"))
    short = needed.filter(F.array_contains("techniques", "compression")).select("qid")
    shortened = rerank.compress(final.join(short, "qid", "left_semi")).withColumn("text", F.col("compressed")).drop("compressed")
    built = context.build(needed, final.join(short, "qid", "left_anti").unionByName(shortened), budget)
    out = routed.join(built, "qid", "left").join(facts.select("qid", "confidence", "label"), "qid", "left").join(check, "qid", "left")
    simple = F.col("route") == routing.SIMPLE
    out = out.withColumns(
        {
            "label": F.when(simple, "Not Applicable").otherwise(F.col("label")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "prompt": F.when(simple, F.col("text")).otherwise(context.prompt(F.col("text"), F.coalesce("context", F.lit("")))),
            "system": F.when(simple, DIRECT_PROMPT).otherwise(context.SYSTEM_PROMPT),
        }
    )
    if "history" in questions.columns:
        out = out.withColumn("prompt", context.with_history(F.col("prompt"), F.col("history")))
    return llm.generate(out, "system", "prompt", "answer")


def baseline(questions: DataFrame, chunks: DataFrame, top_k: int = 5, llm: hooks.LLM | None = None) -> DataFrame:
    """One wording, top_k hits, no reranking."""
    one = questions.select("qid", F.lit(0).alias("query_idx"), "text")
    of = _attributed(chunks)
    built = context.build(questions, retrieval.met(of, written(retrieve(one, chunks, top_k), "hits")))
    out = questions.join(built, "qid").withColumn("prompt", context.prompt(F.col("text"), F.col("context")))
    return (llm or hooks.MockLLM()).generate(out.withColumn("system", F.lit(context.SYSTEM_PROMPT)), "system", "prompt", "answer")
