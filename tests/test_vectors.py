import numpy as np
import pytest

from docloom.operators import tiles, vectors


def brute(queries, chunks, k):
    """Of (query, vector, label) and (chunk_id, vector, label): rows (query, chunk_id, score, rank)."""
    fine = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)

    def unit(v):
        x = np.array(v, float)
        x = x / (abs(x).max() or 1)
        return x / (np.linalg.norm(x) or 1)

    good = [(c, unit(v), g) for c, v, g in chunks if c is not None and fine(v)]
    out = []
    for q, v, g in queries:
        if not fine(v):
            continue
        x = unit(v)
        scored = sorted((-round(float(x @ y), 6) + 0.0, c) for c, y, h in good if len(y) == len(x) and (g is ... or g is not None and g == h))
        out += [(q, c, -s, i + 1) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def same(df, want):
    got = sorted(((r.query, r.chunk_id, r.score + 0.0, r["rank"]) for r in df.collect()), key=lambda r: (r[0], r[3]))
    want = sorted(want, key=lambda r: (r[0], r[3]))
    assert [(a[0], a[3]) for a in got] == [(a[0], a[3]) for a in want]
    for a, b in zip(got, want):
        # a score on the edge of two roundings may fall either way
        assert abs(a[2] - b[2]) <= 1.1e-6 and (a[1] == b[1] or abs(a[2] - b[2]) > 0 or a[2] != b[2])
    return got


def clustered(seed, n, size, centres):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, size))
    return [[float(np.float32(x)) for x in c[i % centres] + 0.05 * r.normal(size=size)] for i in range(n)]


ODD = [None, [], [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0], [1.0, 2.0], [2.0, 4.0], [3.0], [0.0] * 12, [1e200] * 12, [1e-200] * 12]


@pytest.mark.parametrize("where", [None, "label"])
@pytest.mark.parametrize("block_rows", [40, 4000])
def test_equals_brute_force_in_tiles_and_by_broadcast(spark, where, block_rows):
    rows = clustered(1, 900, 12, 9)
    rows += [rows[5]] * 60 + ODD  # many that tie
    labels = [(i * 7) % 3 if i % 50 else None for i in range(len(rows))]
    chunks = [(f"c{i:05d}", v, g) for i, (v, g) in enumerate(zip(rows, labels))]
    asked = [(i, v, labels[(i * 3) % len(labels)]) for i, v in enumerate(rows[:260] + [rows[5]] * 2 + ODD)]
    q = spark.createDataFrame(asked, "query long, vector array<double>, label int").repartition(3)
    c = spark.createDataFrame(chunks + [(None, rows[0], 1)], "chunk_id string, vector array<double>, label int").repartition(5)
    got = vectors.cosine_topk(q, c, 4, where, block_rows)
    want = brute(asked if where else [(i, v, ...) for i, v, _ in asked], chunks, 4)
    same(got, want)
    # of equal scores the smaller id comes first
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append(r)
    for hits in by.values():
        hits.sort(key=lambda r: r["rank"])
        assert all((-a.score, a.chunk_id) < (-b.score, b.chunk_id) for a, b in zip(hits, hits[1:]))


def test_far_tiles_are_not_run(spark):
    rows = clustered(3, 3000, 16, 30)
    c = spark.createDataFrame(list(enumerate(rows)), "chunk_id long, vector array<double>").repartition(6)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(rows) if i % 10 == 0], "query long, vector array<double>")
    got, counts = vectors.topk_tiles(q, c, 5, block_rows=50)
    same(got, brute([(i, v, ...) for i, v in enumerate(rows) if i % 10 == 0], [(i, v, 0) for i, v in enumerate(rows)], 5))
    assert counts["seeds"] <= counts["run"] < counts["all"] / 3
    made = vectors.index(c, block_rows=50)
    again, _ = vectors.topk_tiles(q, c, 5, made=made, block_rows=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_empty_tables_and_no_hits(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>")
    c = spark.createDataFrame([("a", [0.0, 1.0])], "chunk_id string, vector array<double>")
    for rows in (1, 100):
        two = q.union(q).union(q)  # more than a block of one
        assert vectors.cosine_topk(two, c.limit(0), 3, None, rows).count() == 0
        assert vectors.cosine_topk(q.limit(0), c, 3, None, rows).count() == 0
        assert [tuple(r) for r in vectors.cosine_topk(two, c, 3, None, rows).collect()] == [(1, "a", 0.0, 1)] * 3
    assert vectors.cosine_topk(q, c, 0).count() == 0


def test_best_of_many_ties():
    best = tiles.Best(2, 3)
    for names in (np.arange(10, 20), np.arange(0, 10)):
        best.offer(np.ones((2, 10)), names)
    assert [x.tolist() for x in best.found()] == [[0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2], [1.0] * 6]
