from collections import Counter

from docloom.operators import retrieval
from docloom.sources.tables import spread, table


def test_spread_keeps_rows_and_uses_all_cores(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "few.parquet"))
    few = table(spark, str(tmp_path), "few", "doc_id")
    cores = spark.sparkContext.defaultParallelism
    assert few.rdd.getNumPartitions() == cores
    assert sorted(r.doc_id for r in few.collect()) == list(range(100))
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many, "id") is many
    empty = spread(spark.createDataFrame([], "doc_id long"), "doc_id")
    assert empty.columns == ["doc_id"] and empty.collect() == []


def test_postings_count_each_term_of_a_chunk(spark):
    texts = ["b a b c b a", "one", "", None, "the " * 3, "x " * 500 + "y"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    got = {(r.chunk_id, r.term): (r.dl, r.tf) for r in retrieval.postings(chunks).collect()}
    words = {"0": "b b a b c a".split(), "1": ["one"], "5": ["x"] * 500 + ["y"]}
    stop = {w for (_, w) in got} ^ {w for ws in words.values() for w in ws}
    for chunk, all_ in words.items():
        kept = [w for w in all_ if w not in stop]
        for term, n in Counter(kept).items():
            assert got[chunk, term] == (len(kept), n)
    assert not {c for c, _ in got} & {"2", "3", "4"}
