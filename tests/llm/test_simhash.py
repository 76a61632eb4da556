import random

import numpy as np
import xxhash

from docloom.llm.simhash import fingerprint, jaccard, keep_one, simhash_components
from docloom.llm.common import connected_components


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def made():
    r = random.Random(7)
    texts = [None, "", " \n", "A b", "a B", "x"]
    for _ in range(12):
        base = [r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 30)) for _ in range(r.randint(2, 400))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = "new" + str(r.random())
            texts.append(" ".join(w))
    return texts


def test_components_equal_brute_force(spark):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    fps = [brute_fp(t) for t in texts]
    want = groups(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    rows = simhash_components(df).collect()
    assert {r.id: r.fp % 2**64 for r in rows} == dict(enumerate(fps))
    assert {r.id: r.component_id for r in rows} == dict(enumerate(want))
    assert len(set(want)) < len(texts) - 20


def test_one_of_each_group_stays(spark):
    texts = made()
    rows = list(enumerate(texts)) + [(3, "A b"), (None, "zz top"), (99, "zz top")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, key string")
    data = [(t or "").encode() for t in texts]
    want = groups(len(texts), lambda i, j: jaccard(data[i], data[j], 5) >= 0.8)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want, 99})
    assert keep_one(df.limit(0)).count() == 0


def test_long_chains_and_stars_have_one_root(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (159, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} | {got[200]} == {100}


def test_fingerprint_of_a_text_longer_than_a_step():
    text = " ".join(str(i % 977) for i in range(70000)).encode()
    assert int.from_bytes(fingerprint(text, 3), "big") == brute_fp(text.decode())


def test_no_near_copy_is_missed_at_the_threshold(spark):
    r = random.Random(3)
    rows, pairs = [], []
    for n, m in [(8, 0)] * 40 + [(10, 0)] * 20 + [(60, 1)] * 20 + [(300, 6)] * 20:
        words = [f"w{r.randrange(10**9)}" for _ in range(n)]
        other = list(words) if m else [*words, "end"]
        for i in r.sample(range(5, n - 5), m) if m else []:
            other[i] = "new"
        a, b = " ".join(words), " ".join(other)
        if jaccard(a.encode(), b.encode(), 5) >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    # a family whose members lie just below 0.8 of each other and one text near to each of two
    base = [f"f{i}" for i in range(104)]
    rows += [(10_000 + i, " ".join(base[:80] + [f"x{i}_{j}" for j in range(24)])) for i in range(60)]
    assert len(pairs) > 80
    got = {x.doc_id for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {a for a, _ in pairs} | {10_000 + i for i in range(60)}


def test_a_frequent_shingle_is_split_without_loss(spark, monkeypatch):
    from docloom.llm import simhash

    monkeypatch.setattr(simhash, "SPLIT", 3)
    schema = "node long, root long, size int, pos int, token long"
    rows = spark.createDataFrame([(i, i, 5, 0, 1) for i in range(20)], schema)
    assert simhash._all_pairs(rows, 0.8).count() == 190


def test_parities_leave_out_no_pair_at_the_threshold(spark):
    from docloom.llm import simhash

    r = np.random.default_rng(5)
    rows, want = [], set()
    for i in range(300):
        common, x, y = (r.integers(0, 2**64, n, np.uint64) for n in (r.integers(1, 1500), r.integers(0, 300), r.integers(0, 300)))
        a, b = np.unique(np.concatenate([common, x])), np.unique(np.concatenate([common, y]))
        differ = np.unpackbits((simhash.parities(a) ^ simhash.parities(b)).view(np.uint8)).sum()
        assert differ <= len(np.setxor1d(a, b))
        n = len(np.intersect1d(a, b))
        if n / (len(a) + len(b) - n) >= 0.8:
            want.add((2 * i, 2 * i + 1))
        rows += [(2 * i + j, 2 * i + j, len(h), 0, i, simhash.parities(h).tolist()) for j, h in enumerate((a, b))]
    df = spark.createDataFrame(rows, "node long, root long, size int, pos int, token long, sketch array<long>")
    got = simhash._all_pairs(df.drop("sketch"), 0.8, df.select("node", "sketch"))
    found = {(min(x.a, x.b), max(x.a, x.b)) for x in got.collect()}
    assert want and want <= found and len(found) < 300
