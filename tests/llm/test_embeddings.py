import random

import numpy as np
import pytest

from docloom.llm.embeddings import near_vectors


def brute(rows, least, kind=np.float32):
    good = {}
    for n, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, kind).astype(float)
            good[n] = (label, x)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in good:
        for j in good:
            (a, x), (b, y) = good[i], good[j]
            if i < j and a == b and len(x) == len(y) and x / abs(x).max() @ (y / abs(y).max()) / np.sqrt((x / abs(x).max()) @ (x / abs(x).max()) * ((y / abs(y).max()) @ (y / abs(y).max()))) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for n, (i, _, _) in enumerate(rows):
        groups.setdefault(find(n), []).append(i)
    out = []
    for n, (i, _, _) in enumerate(rows):
        c = min((x for x in groups[find(n)] if x is not None), default=None)
        out.append((i, links[n], c, i == c))
    return out


@pytest.mark.parametrize("size", [64, 5, 2])
def test_equals_brute_force(spark, size):
    r = np.random.default_rng(size)
    rows = []
    for g in range(60):
        base = r.normal(size=size)
        for _ in range(int(r.integers(1, 9))):
            v = base + r.normal(size=size) * r.choice([0.02, 0.1, 0.14, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * r.choice([0.1, 1, 30])], int(g % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, None, 1), (n + 3, [0.0] * size, 1)]
    rows += [(n + 4, [float("nan")] * size, 1), (n + 5, [None] * size, 1), (n + 6, [], 1), (None, rows[3][1], rows[3][2])]
    rows += [(n + 7, [1.0] * (size + 1), 1), (n + 8, [1.0] * (size + 1), 1), (0, rows[0][1], rows[0][2]), (n + 9, [float("inf")] * size, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = near_vectors(df).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 0.98), key=key)
    assert near_vectors(df.limit(0)).count() == 0


def test_very_large_and_small_vectors_and_other_columns(spark):
    rows = [(1, [1e200, 2e200], 1, "a"), (2, [1e-200, 2e-200], 1, "b"), (3, [1.0, 2.01], 1, "c"), (4, [-1e200, -2e200], 1, "d"), (5, [5e-324, 1e-323], 1, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute([x[:3] for x in rows], 0.98, float)
