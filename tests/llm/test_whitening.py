import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, whitening


def exact(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 if abs(c) < 2**52 else int(c) * 64 + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    return n, far, far.T @ far


def check(rows, vectors, components):
    """rows: vec_id to its rows in order of components."""
    n, far, scatter = exact(list(vectors.values()))
    a = np.array(scatter / (int(np.trace(scatter)) or 1), float)  # n * A / trace
    values, axes = np.linalg.eigh(a)
    values, axes = values[::-1], axes[:, ::-1]
    assert rows.keys() == vectors.keys()
    count = min(components, a.shape[0])
    w = np.zeros((len(rows), count))
    for at, i in enumerate(vectors):
        mine = rows[i]
        assert [r.component for r in mine] == list(range(1, count + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {sum(int(e) ** 2 for e in far[at])}
        w[at] = [math.nan if r.whitened is None else r.whitened for r in mine]
    for k, r in enumerate(next(iter(rows.values()))):
        assert abs(r.explained - values[k]) <= 1e-9 * max(1e-3, abs(values[k]))
    live = ~np.isnan(w).any(0)
    cov = w[:, live].T @ w[:, live] / n
    assert abs(cov - np.eye(live.sum())).max() < 1e-8 and next(iter(rows.values()))[0].identity_error < 1e-8
    return w, far, values, axes


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id if "id" in r else r.vec_id, r.component)):
        out.setdefault(r.id if "id" in r else r.vec_id, []).append(r)
    return out


def test_query_equals_a_plain_decomposition(spark):
    d = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)}
    got = queries.op11_embedding_whitening(spark, d)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    w, far, values, axes = check(collected(got), vectors, 32)
    n = len(far)
    for k in range(32):
        mine = (far / n).astype(float) @ axes[:, k]
        mine /= np.sqrt((mine**2).mean())
        assert min(abs(mine - w[:, k]).max(), abs(mine + w[:, k]).max()) < 1e-9


def test_odd_rows_and_dependent_dimensions(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 3))
    x = np.hstack([x, x[:, :1], np.ones((40, 1))])  # rank 3 of 5
    rows = [(i, [float(c) for c in v], "a") for i, v in enumerate(x)]
    odd = [(100, None, "b"), (101, [float("nan")] * 5, "b"), (102, [1.0, None, 1.0, 1.0, 1.0], "b"), (103, [], "b"), (104, [float("inf")] * 5, "b"), (105, [1.0], "b"), (106, [1.0, 2.0, 3.0, 4.0], "b")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string").repartition(4)
    got = collected(whitening.whiten(df, components=9))
    w, *_ = check(got, {i: v for i, v, _ in rows}, 9)
    assert np.isnan(w).all(0).tolist() == [False, False, False, True, True]
    assert [x.explained for x in got[0]][3:] == [0, 0]
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.filter("vec_id = 3")).collect()
    assert [(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 0, None, 0.0, 0.0)] * 5


def test_equal_eigenvalues_and_close_ones(spark):
    rows = []
    for axis in range(4):
        for sign in (-1, 1):
            for times in range(1 if axis < 3 else 2):
                v = [0.0] * 6
                v[axis] = sign * 4.0
                v[4], v[5] = 100.0, (sign * 2.0**-3 if axis == 0 else 0.0)
                rows.append((len(rows), v))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(collected(whitening.whiten(df, components=3)), dict(rows), 3)  # the cut falls among equal ones
    check(collected(whitening.whiten(df, components=6)), dict(rows), 6)


def test_very_large_entries_stay_exact(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(30, 4)) * [1e300, 1, 1e18, 3e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    n, far, scatter = exact([v for _, v in rows])
    got_n, _, a = whitening.scatter(df.select(F.col("embedding").alias("vector")), 4)
    assert got_n == n and (np.array(a, object) * n == scatter).all()
    out = collected(whitening.whiten(df))
    assert {r.deviation for x in out.values() for r in x} == {None} and abs(out[0][0].explained - 1) < 1e-12
    assert out[0][0].identity_error < 1e-4


def faddeev(a):
    """Coefficients of det(t - a) by traces of products, in whole numbers."""
    d = len(a)
    m, c = np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a @ m + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-int(np.trace(a @ m)) // k)
    return c[::-1]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_polynomial_and_roots(spark, size):
    r = np.random.default_rng(size)
    b = r.integers(-50, 50, size=(size, size + 1))
    if size > 2:
        b[1] = b[0]
    a = b @ b.T
    p = whitening.polynomial(spark, a.tolist())
    assert p == faddeev(a.astype(object))
    trace = int(np.trace(a))
    values = np.linalg.eigvalsh(a)[::-1]
    for k in range(1, size + 1):
        m, s = whitening.root(p, k, trace)
        assert abs(m / 2**s - values[k - 1]) < 1e-8 * trace
    assert whitening.primes_below(1 << 31, 3) == [2147483647, 2147483629, 2147483587] and whitening.primes_below(30, 4) == [29, 23, 19, 17]


def test_polynomial_of_a_matrix_without_pivots():
    a = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 5, 0], [1, 0, 0, 7]])
    p = 2147483629
    got = whitening.polynomial_mod(a, p)
    assert [x if x < p // 2 else x - p for x in got] == [round(x) for x in np.poly(a)[::-1]]
