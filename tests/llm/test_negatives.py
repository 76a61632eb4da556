import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives, queries

MOST = (1 << 63) - 1


def brute(rows, asks, positives=5, negs=3, low=50, high=95):
    """rows: (id, vector, label); asks: whether an id is an anchor's."""
    good = [(i, [math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v], g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, x, g) in enumerate(good):
        if not asks(a):
            continue
        scored = [(-max(-MOST, min(MOST, sum(p * q for p, q in zip(x, y)))), i, h == g) for k, (i, y, h) in enumerate(good) if k != at and len(y) == len(x)]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [r for r in scored if not r[2] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit[:negs])]
    return sorted(out)


def test_query_equals_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op13_hard_negatives(spark, d)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert got == sorted(con.sql(negatives.sql()).fetchall()) and got
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert got == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_odd_rows_ties_and_many_blocks(spark, monkeypatch, block_rows):
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 9))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + 0.3 * r.normal(size=9)], int(r.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(80)]  # a hot vector: ties by id
    rows += [(900, None, 1), (901, rows[1][1], None), (902, [], 1), (903, [float("nan")] * 9, 1), (904, [None] * 9, 1), (None, rows[2][1], 1), (905, [1.0, 2.0], 1), (910, [1.5, 2.0], 1), (906, [1.2, 1.0], 2)]
    rows += [rows[10], rows[15]]  # an anchor and another row again
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    monkeypatch.setattr(negatives.tiles, "BLOCK_ROWS", block_rows)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_wide_words(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.abs(r.normal(size=(60, 4))) * [1e12, 1, 3e15, 1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") < 9).collect())) == brute(rows, lambda i: i < 9)


@pytest.mark.parametrize("top", [1, 300, 40_000, 1 << 24, 1 << 28])
def test_packed_products_are_exact(top):
    r = np.random.default_rng(top)
    a, x = r.integers(-top, top, size=(5, 16)), r.integers(-top, top, size=(23, 16))
    assert (negatives.scores(a, x).astype(object) == a.astype(object) @ x.astype(object).T).all()
    assert (negatives.scores(abs(a), -abs(x)).astype(object) == abs(a).astype(object) @ -abs(x).astype(object).T).all()
    assert negatives.scores(a, x[:1]).shape == (5, 1)
