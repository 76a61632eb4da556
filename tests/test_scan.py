"""BM25 by scanning gives the hits of postings; tokens are those of Spark's expressions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed as X
from docloom.functions import text as T
from docloom.operators import chunking, embed, retrieval, scan, vectors

ODD = ["", None, "Ab-c1 ñandú 42", "إلى المدرسة الكبيرة، قالَ؟ yes", "   ", "ÀÉ x", "the the the", "a b ", "end", "ࢠxٱ ـــ ؟", "tab\tnew\nline", "İstanbul İ", "z" * 300]


def words_of(column, normal):
    row, code, words = scan.coded(column, normal)
    out = [[] for _ in range(len(column))]
    for r, c in zip(row.tolist(), code.tolist()):
        out[r].append(words[c].decode())
    return out


@pytest.mark.parametrize("texts", [ODD, [t for t in ODD if not t or t.isascii() or t[0] in "ÀA"], [], ["", None]])
def test_tokens_are_those_of_the_expressions(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    lower = [r.t for r in rows.orderBy("i").select(F.lower("text").alias("t")).collect()]
    want = [r.t or [] for r in rows.orderBy("i").select(T.tokens(F.col("text")).alias("t")).collect()]
    got = words_of(pa.array(lower, pa.string()), True)
    assert [[w for w in g if w not in T.STOPWORDS] for g in got] == want
    raw = [r.t or [] for r in rows.orderBy("i").select(F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(0)).alias("t")).collect()]
    assert words_of(pa.array(lower, pa.string()), False) == raw
    assert words_of(pa.array(["zz", *lower], pa.string()).slice(1), False) == raw


def table(spark, n=400):
    r = random.Random(4)
    some = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(r.choices(some, k=r.randrange(0, 40))) + (" common" if i % 3 else "") for i in range(n)] + ODD
    chunks = spark.createDataFrame([(f"c{i % 7}-{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(5)
    asked = [(i, j, " ".join(r.choices(some, k=6)) + (" common" if j else "")) for i in range(30) for j in range(2)] + [(98, 0, "المدرسة قال"), (99, 0, " "), (97, 0, "unknownword")]
    return spark.createDataFrame(asked, "qid long, query_idx int, text string"), chunks


def hits(df):
    return sorted((r.qid, r.query_idx, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_hits_are_those_of_postings(spark, monkeypatch):
    asked, chunks = table(spark)
    want = hits(retrieval.bm25(asked, chunks, 7, retrieval.index(chunks)))
    monkeypatch.setattr(scan, "KNOWN", 50)
    assert hits(retrieval.bm25(asked, chunks, 7)) == want and len(want) > 300
    monkeypatch.setattr(scan, "DENSE", 0)
    assert hits(retrieval.bm25(asked, chunks, 7)) == want
    monkeypatch.setattr(scan, "QUESTIONS", 3)  # more than a block: postings
    assert hits(retrieval.bm25(asked, chunks, 7)) == want


def test_no_postings_are_written_for_a_block_of_questions(spark, monkeypatch):
    asked, chunks = table(spark, 20)

    def never(*_):
        raise AssertionError("postings of all terms")

    monkeypatch.setattr(retrieval, "index", never)
    assert hits(retrieval.bm25(asked, chunks, 7))


def test_negative_weights_keep_their_hits(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "one"), ("c", "one three")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, "one")], "qid long, query_idx int, text string")
    want = hits(retrieval.bm25(asked, chunks, 5, retrieval.index(chunks)))
    assert hits(retrieval.bm25(asked, chunks, 5)) == want and len(want) == 3


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (1000, 150)])
def test_windows_of_long_texts(spark, size, overlap):
    r = random.Random(size)
    texts = ["".join(r.choice("ab \n\xa0ñ😀م") for _ in range(n)) for n in (1, 6, 7, 10, 11, 160, 1151, 30000)] + ["", None]
    got = chunking.fixed_size(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).collect()
    want = []
    for i, t in enumerate(texts):
        at, n = 0, len(t or "")
        for w in range(0 if not n else 1 if n <= size else -(-(n - size) // (size - overlap)) + 1):
            a = w * (size - overlap)
            piece = t[a : a + size].strip(" \t\n\x0b\f\r\xa0")
            if piece:
                want.append((i, at, piece, a, min(a + size, n)))
                at += 1
    assert sorted((x.doc_id, x.position, x.text, x.char_start, x.char_end) for x in got) == want


def test_texts_meet_queries_where_they_lie(spark):
    asked, chunks = table(spark, 300)
    e = embed.HashingEmbedder()
    q = e.embed(asked, ["qid", "query_idx"], "text").select((F.col("qid") * 10 + F.col("query_idx")).alias("query"), "vector")
    key = lambda df: sorted((r["query"], r.chunk_id, r.score, r["rank"]) for r in df.collect())
    want = key(retrieval.cosine_topk(q, e.embed(chunks, ["chunk_id"], "text"), 9))
    assert key(vectors.topk_texts(q, chunks, 9, e)) == want
    with_own = q.withColumn("filter", F.when(F.col("query") % 3 != 0, (F.col("query") % 4).cast("int")))
    fits = chunks.withColumn("fits", F.when(F.length("text") % 5 != 0, F.array((F.length("text") % 2).cast("int"), F.lit(3))))
    got = key(vectors.topk_texts(with_own, fits, 9, e))
    every = vectors.cosine_topk(q, e.embed(chunks, ["chunk_id"], "text"), 1000).join(with_own.select("query", "filter"), "query").join(fits.select("chunk_id", "fits"), "chunk_id")
    good = every.filter("filter is null or array_contains(fits, filter)").collect()
    by = {}
    for r in sorted(good, key=lambda r: (-r.score, r.chunk_id)):
        by.setdefault(r["query"], []).append((r["query"], r.chunk_id, r.score, len(by.get(r["query"], [])) + 1))
    assert got == sorted(x for rows in by.values() for x in rows[:9])
    monkey = key(vectors._topk_each(with_own, fits, 9, e, True))
    assert monkey == got
