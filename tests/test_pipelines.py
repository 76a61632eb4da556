"""The branches of the conditional pipeline."""

from pyspark.sql import functions as F

from docloom.functions import fixed as X
from docloom.operators import routing
from docloom.plans import pipelines


class Recorder:
    """Answers with the prompt."""

    def generate(self, df, system, prompt, out):
        return df.withColumn(out, F.col(prompt))


def test_branches_follow_route_and_techniques(spark, monkeypatch):
    def decide(question):
        some = lambda route, *t: F.struct(F.lit(route).alias("route"), F.lit("").alias("reason"), F.array(*map(F.lit, t)).cast("array<string>").alias("techniques"))
        return (
            F.when(question.startswith("hello"), some(routing.SIMPLE))
            .when(question.startswith("checked"), some(routing.ADVANCED, "crag"))
            .when(question.startswith("short"), some(routing.ADVANCED, "compression"))
            .when(question.startswith("many"), some(routing.ADVANCED, "decomposition"))
            .otherwise(some(routing.BASIC))
        )

    monkeypatch.setattr(routing, "route", decide)
    chunks = spark.createDataFrame(
        [(f"c{i}", t) for i, t in enumerate(["apples grow on trees", "ships sail on seas. Nothing else here. Far away things. mountains", "iron rusts", "birds fly south"])],
        "chunk_id string, text string",
    )
    rows = [
        (1, "hello", None), (2, "apples trees", ["iron rusts"]), (3, "checked zebra", ["birds fly south"]),
        (4, "short ships", None), (5, "many apples", ["iron rusts", "birds fly"]),
    ]
    asked = spark.createDataFrame(rows, "qid long, text string, generated array<string>")
    got = {r.qid: r for r in pipelines.answer(asked, chunks, 5, Recorder()).collect()}
    assert got[1].prompt == "hello" and got[1].label == "Not Applicable" and got[1].system == pipelines.DIRECT_PROMPT and got[1].context is None
    assert got[2].action is None and got[2].confidence > 0 and "SCORE" in got[2].context
    assert got[3].action == "rewrite" and "birds fly south" in got[3].context
    assert "Far away things" not in got[4].context and "ships sail on seas" in got[4].context and "Far away things" in got[2].context
    assert got[5].techniques == ["decomposition", "reranking"] and "iron rusts" in got[5].context and X.BLOCK_SEPARATOR in got[5].context


def test_replies_of_models_reach_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(routing, "by_rules", lambda q: F.lit(None).cast("struct<route:string,reason:string,techniques:array<string>>"))
    some = ["apples grow on trees", "ships sail on seas", "iron rusts in rain", "birds fly south", "iron is heavy"]
    chunks = spark.createDataFrame(
        [(f"c{i}", t, {"department": "north" if i % 2 else "south", "source": f"s{i}.txt", "page": str(i)}) for i, t in enumerate(some)],
        "chunk_id string, text string, metadata map<string,string>",
    )
    advanced = lambda *t: '{"route": "advanced_rag", "techniques": [%s]}' % ", ".join(f'"{x}"' for x in t)
    rows = [
        (1, "hello there", {"router": '{"route": "simple"}'}),
        (2, "zebra", {"router": advanced("rewriting"), "rewriting": '{"query": "apples"}', "multi_query": '{"queries": ["birds"]}'}),
        (3, "zebra", {"router": advanced("decomposition"), "decomposition": '{"subquestions": ["ships seas", "birds south"]}'}),
        (4, "iron", {"router": advanced("self_query"), "self_query": '{"semantic_query": "iron", "filters": {"department": "NORTH", "other": 1}}'}),
        (5, "zebra", {"router": advanced("hyde", "crag"), "hyde": "ships sail", "rewriting": '{"query": "birds south"}'}),
        (6, "zebra", {"router": "no json at all"}),
    ]
    asked = spark.createDataFrame([(i, t, None, r) for i, t, r in rows], "qid long, text string, generated array<string>, replies map<string,string>")
    got = {r.qid: r for r in pipelines.answer(asked, chunks, 1, Recorder()).collect()}
    assert got[1].route == routing.SIMPLE and got[1].prompt == "hello there"
    assert got[2].generated == ["apples"] and "apples grow" in got[2].context  # of the listed technique alone
    assert got[3].subquestions == ["ships seas", "birds south"] and got[3].techniques == ["decomposition", "reranking"]
    assert "ships sail" in got[3].context or "birds fly" in got[3].context
    assert got[4].wanted == {"department": "north".upper()} and all(x.source in ("s1.txt", "s3.txt") for x in got[4].sources)
    assert got[5].action == "rewrite" and "birds fly south" in got[5].context  # what was rewritten, not the passage
    assert got[6].route == routing.BASIC and got[6].generated is None or got[6].generated == []
    assert all(x.page is not None for x in got[4].sources)  # of the metadata


def test_merged_hits_keep_their_sub_question(spark):
    from docloom.operators import retrieval

    rows = [(1, 0, "a", 0.9, 1), (1, 0, "b", 0.5, 2), (1, 1, "b", 0.5, 1), (1, 2, "b", 0.7, 1), (1, 2, "c", 0.4, 2), (1, 1, "d", 0.4, 2), (2, 0, "a", 0.3, 1)]
    hits = spark.createDataFrame(rows, "qid long, query_idx int, chunk_id string, score double, rank int")
    got = {(r.qid, r.chunk_id): (r.score, r.best_query, list(r.queries), list(r.scores), r.sub_index, r["rank"]) for r in retrieval.merge_decomposed(hits).collect()}
    assert got == {
        (1, "a"): (0.9, 0, [0], [0.9, 0.9], None, 1),
        (1, "b"): (0.7, 2, [1, 2, 0], [0.5, 0.5, 0.7, 0.5], 1, 2),
        (1, "d"): (0.4, 1, [1], [0.4, 0.4], 1, 3),
        (1, "c"): (0.4, 2, [2], [0.4, 0.4], 2, 4),
        (2, "a"): (0.3, 0, [0], [0.3, 0.3], None, 1),
    }
