import random

import pytest

from docloom.operators import blockmax, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rare = [f"rare{i}" for i in range(150)]
    rows = []
    for i in range(3000):
        words = ["river"] * r.randint(1, 4) + [r.choice(("stone", "meadow", "harbour", "lantern")) for _ in range(r.randint(3, 25))]
        if i % 5 == 0:
            words += r.choices(rare, k=2)
        r.shuffle(words)
        rows.append((f"c{i:05d}", " ".join(words)))
    rows += [("x1", None), ("x2", ""), ("x3", "the of and")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(6)
    asked = [(i, 0, f"river stone {rare[i]} {rare[i + 1]}") for i in range(40)]
    asked += [(100, 0, "river"), (101, 0, "river river lantern"), (102, 0, "  "), (103, 0, "unknown word"), (104, 0, None), (105, 1, "rare7 rare7"), (105, 2, "meadow rare9 unheard")]
    return chunks, spark.createDataFrame(asked, "qid long, query_idx int, text string")


@pytest.mark.parametrize("top_k", [1, 5, 40])
@pytest.mark.parametrize("bits", [2, 5, 8])
def test_same_hits_as_without_blocks(spark, corpus, top_k, bits):
    chunks, asked = corpus
    hits, _ = blockmax.bm25(asked, chunks, top_k, blockmax.index(chunks, bits))
    want = retrieval.bm25(asked, chunks, top_k)
    key = lambda r: (r.qid, r.query_idx, r.chunk_id, r.score, r["rank"])
    assert sorted(map(key, hits.collect())) == sorted(map(key, want.collect()))


def test_blocks_of_frequent_terms_are_skipped(spark, corpus):
    chunks, asked = corpus
    made = blockmax.index(chunks, 4)
    hits, work = blockmax.bm25(asked, chunks, 3, made)
    by = {(r.qid, r.query_idx): r for r in work.collect()}
    n_blocks = made[0].select("block").distinct().count()
    for i in range(40):  # every chunk has "river", so every block is asked for; few are scored
        assert by[i, 0].blocks == n_blocks and by[i, 0].blocks_run < n_blocks / 5 and by[i, 0].postings_run < by[i, 0].postings / 5
    assert all(r.blocks_run <= r.blocks and r.postings_run <= r.postings for r in by.values())
    assert (102, 0) not in by and (103, 0) not in by


def test_a_row_is_bounded_and_empty_tables(spark, corpus):
    chunks, asked = corpus
    packed, terms, totals, members = blockmax.index(chunks, 3)
    assert packed.filter("n_post > 8").isEmpty() and members.filter("size(ids) > 8 or size(ids) <> size(dls)").isEmpty()
    want = {(r.term, r.df, round(r.idf, 9)) for r in retrieval.index(chunks)[1].collect()}
    assert {(r.term, r.df, round(r.idf, 9)) for r in terms.collect()} == want and totals.first().n == 3003
    for q, c in ((asked.limit(0), chunks), (asked, chunks.limit(0)), (asked, chunks.filter("chunk_id like 'x%'"))):
        hits, work = blockmax.bm25(q, c, 3)
        assert hits.count() == 0 and work.count() == 0
