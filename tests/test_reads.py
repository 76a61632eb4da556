"""What registered queries read and move: texts once or twice, and no row of them through a shuffle for a few hits."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import embed, filtering, retrieval, vectors
from docloom.plans import registry

DATA = "/root/testdata/sf0.001"


def counted(spark, rows, schema):
    """A table, and how many of its rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), made


HITS = "qid long, query_idx int, chunk_id string, score double, rank int"


def test_weighted_fusion_makes_each_side_once(spark):
    one, a = counted(spark, [(1, 0, "x", 0.9, 1), (1, 0, "y", 0.4, 2), (2, 0, "x", 0.5, 1)], HITS)
    two, b = counted(spark, [(1, 0, "y", 7.0, 1), (1, 0, "z", 3.0, 2)], HITS)
    got = {(r.qid, r.chunk_id): (r.score, r.semantic_score, r.keyword_score, r["rank"]) for r in retrieval.weighted(one, two, 0.4).collect()}
    assert got == {(1, "y"): (0.6, 0.4, 7.0, 1), (1, "x"): (0.4, 0.9, None, 2), (1, "z"): (0.0, None, 3.0, 3), (2, "x"): (0.0, 0.5, None, 1)}
    assert (a.value, b.value) == (3, 2)


def test_query_stats_makes_hits_once(spark):
    hits, made = counted(spark, [(1, 0, "x", 0.9, 1), (1, 0, "y", 0.4, 2), (1, 1, "y", 0.4, 6)], HITS)
    chunks = spark.createDataFrame([("x", "ab"), ("y", "c")], "chunk_id string, text string")
    got = [(r.qid, r.query_idx, r.result_count, r.top_chunks, r.previews) for r in retrieval.query_stats(hits, chunks).collect()]
    assert got == [(1, 0, 2, ["x", "y"], ["ab", "c"])] and made.value == 3


@pytest.fixture
def plain_joins(spark):
    """Only what a count found small is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_by(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("SortMergeJoin" in line and f"[{key}#" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["rerank_features", "rerank_topk", "query_stats", "hybrid_by_own_filter"])
def test_few_hits_go_to_the_texts(plain_joins, name):
    assert not shuffled_by(registry.QUERIES[name](plain_joins, DATA), "chunk_id")


@pytest.mark.parametrize("name", ["multi_query_merge", "decomposed_tags", "weighted_fusion"])
def test_a_block_of_questions_makes_no_index(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("postings of all terms")

    monkeypatch.setattr(retrieval, "index", never)
    assert registry.QUERIES[name](spark, DATA).filter(F.col("rank") == 1).count() >= 40


@pytest.fixture
def no_tables(monkeypatch):
    """Fails where postings of all terms, or vectors of chunks, are made as a table."""
    made = embed.HashingEmbedder.embed

    def never(*_):
        raise AssertionError("postings of all terms")

    def of_questions(self, df, id_cols, *rest, **more):
        assert "chunk_id" not in id_cols, "vectors of all chunks"
        return made(self, df, id_cols, *rest, **more)

    monkeypatch.setattr(retrieval, "index", never)
    monkeypatch.setattr(embed.HashingEmbedder, "embed", of_questions)


@pytest.mark.parametrize("name", ["semantic_by_own_filter", "baseline_answers", "pipelines_compared", "replied_answers"])
def test_no_vectors_or_postings_are_tables(spark, no_tables, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 40


def test_filters_by_number_equal_copies_of_vectors(spark, monkeypatch):
    """A chunk is scored once, however many filters let it through; for more filters than a list holds it stands once for each."""
    e = embed.HashingEmbedder()
    asked = registry._filtered_questions(spark, DATA).select("qid", "text", "wanted")
    own = registry._filtered_chunks(spark, DATA).union(spark.createDataFrame([("x:1", "de la", None), ("x:2", "de la", {})], "chunk_id string, text string, metadata map<string,string>"))
    of = e.embed(asked, ["qid"], "text").join(asked.select("qid", "wanted"), "qid").withColumnRenamed("qid", "query")
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "rank", "chunk_id", "score").collect())
    scored, found = vectors.cosine_topk, []
    monkeypatch.setattr(vectors, "cosine_topk", lambda *a, **b: found.append(1) or scored(*a, **b))
    got = rows(filtering.topk_texts(of, own, 10, e))
    assert not found
    monkeypatch.setattr(filtering, "FILTERS", 3)
    assert rows(filtering.topk_texts(of, own, 10, e)) == got and len(found) == 1 and len(got) > 100
