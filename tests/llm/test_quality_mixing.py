import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, quality

ROWS = [
    (1, None),
    (2, ""),
    (3, "Home\nMenu\nA | B | C | D\n" + "Plain words make a fine sentence here, and it goes on for a while. " * 6),
    (4, "Same line here.\nSame line here.\n \n\nOther " + "a b c " * 40),
    (5, "one two three four"),
    (6, "x%%% y### z&&& " * 30),
    (7, " ".join(f"w{i}" for i in range(300)) + ". All rights reserved"),
    (8, "Good text of many words follows now.\n" * 1 + "\n".join(" ".join(f"t{i}n{j}" for j in range(12)) + "." for i in range(30)) + "\nWe use cookies: cookie policy"),
    (9, "a b c a b c d e f a b"),
    (10, "näïve öl   x y\x0bz " * 20),
    (9, "a b c a b c d e f a b"),
]


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_quality_equals_sql_and_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    got = quality.judge(df).select("doc_id", *(F.col(f"__{x}").alias(x) for x in names)).collect()
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ROWS)
    cur = con.execute(quality.sql())
    cols = [x[0] for x in cur.description]
    want = sorted(tuple(dict(zip(cols, r))[c] for c in ("doc_id", *names)) for r in cur.fetchall())
    assert sorted(map(tuple, got)) == want
    for r in got:
        words = (dict(ROWS)[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_repeat_words) == (len(words), repeat_words(words))
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {7, 8}  # 3 repeats itself, 4 to 6 and 10 as well or are too short
    clean = {r.doc_id: r["__clean"] for r in quality.judge(df).collect()}
    assert clean[3].startswith("Plain") and "Menu" not in clean[3] and "cookie" not in clean[8] and clean[1] == ""


def water(sizes, weights, cap):
    left, out = dict(weights), {}
    while True:
        free = sum(sizes.values()) - sum(out.values())
        over = [s for s in left if free * left[s] / sum(left.values()) > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: free * w / sum(left.values()) for s, w in left.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del left[s]


@pytest.mark.parametrize("shares", [(1, 1, 1, 1), (100, 1, 1, 2), (1, 0, 50, 3)])
def test_mixture(spark, shares):
    r = random.Random(5)
    names = ["b", "a", None, "é"]
    rows = [(i, names[j], r.randint(0, 60)) for j, k in enumerate(shares) for i in range(j * 10000, j * 10000 + 40 * k)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, source string, size long")
    mixed = mixing.mix(df, "size", mixing.order_key("doc_id"))
    got = mixed.collect()
    assert len(got) == len(rows) + 3
    have = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(have)}
    sizes = {s: sum(x["size"] for x in got if x.source == s) for s in have}
    want = water(sizes, weights, 3)
    for s in have:
        mine = [x for x in got if x.source == s]
        assert {x["__source_size"] for x in mine} == {sizes[s]}
        assert abs(mine[0]["__target"] - want[s]) < 1e-6 * max(1, want[s])
        taken = sum(x["size"] * x["__copies"] for x in mine)
        assert abs(taken - want[s]) <= 31 and max(x["__copies"] for x in mine) <= 3
    order = mixing.train_order(mixed, "size", ["doc_id", "source", "size"]).collect()
    assert len(order) == sum(x["__copies"] for x in got)
    at = [x["__position"] for x in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert mixing.mix(df.limit(0), "size", mixing.order_key("doc_id")).count() == 0


def test_early_sources_come_early(spark):
    rows = [(i, s, 10) for i in range(3000) for s in ("a", "b", "c")]
    df = spark.createDataFrame([(i * 3 + "abc".index(s), s, n) for i, s, n in rows], "doc_id long, source string, size long")
    order = mixing.train_order(mixing.mix(df, "size", mixing.order_key("doc_id")), "size", ["source"]).collect()
    half = Counter(x.source for x in order[: len(order) // 2])
    whole = Counter(x.source for x in order)
    assert half["a"] / whole["a"] > 0.55 and abs(half["b"] / whole["b"] - 0.5) < 0.06 and half["c"] / whole["c"] < 0.45


def test_word_count(spark):
    df = spark.createDataFrame([("a b c\x0bd \t",), (None,), ("",)], "t string")
    assert [x[0] for x in df.select(mixing.word_count(F.col("t"))).collect()] == [3, 0, 0]


def test_results_follow_the_curriculum(spark, tmp_path):
    import corpus_pipeline
    from docloom.llm import queries

    rows = [(i, f"{'abc'[i % 3]} {i} x y", "en", "abc"[i % 3], 9) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))), "size", mixing.order_key("doc_id"))
    order = mixing.train_order(mixed, "size", ["doc_id"]).collect()
    first = {}
    for r in order:
        first.setdefault(r.doc_id, r["__position"])
    got = [x.doc_id for x in queries.op6_mixing_target_weights(spark, str(tmp_path)).collect()]
    at = [first.get(x, 2.0) for x in got]
    assert len(got) == 3000 and at == sorted(at) and got != sorted(got)
    stage = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    stage.write.parquet(f"{tmp_path}/mixed")
    again = spark.read.parquet(f"{tmp_path}/mixed")
    for frame in (again, stage):
        out = sorted(corpus_pipeline.encode(spark, frame, str(tmp_path)).collect(), key=lambda x: x.position)
        assert [x.position for x in out] == list(range(len(order)))
        assert Counter(x.doc_id for x in out) == Counter(x.doc_id for x in order)
        place = {}
        for r in order:
            place.setdefault(r.doc_id, []).append(r["__position"])
        assert all(order[x.position]["__position"] in place[x.doc_id] for x in out)


def test_training_positions_do_not_depend_on_the_layout(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "" if i % 2 else f"{'abc'[i % 3]} x y", "en", "abc"[i % 3], 9) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = []
    for n in (3, 9):
        df.repartition(n).write.parquet(f"{tmp_path}/{n}")
        mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/{n}"), "")
        mixed.write.parquet(f"{tmp_path}/mixed{n}")
        ranks = mixing.rank_in_order(spark.read.parquet(f"{tmp_path}/mixed{n}")).collect()
        got.append(sorted((x.position, x.doc_id) for x in ranks))
    assert got[0] == got[1] and len(got[0]) > 2000


def test_stage_leaves_columns_of_clashing_names_alone(spark):
    import corpus_pipeline

    rows = [(i, f"word{i} and more words", "en", "ab"[i % 2], 9, f"w{i}", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __words string, __before long, __copies string")
    out = corpus_pipeline.mix_sources(spark, df, "").collect()
    assert out and all((r["__words"], r["__before"], r["__copies"]) == (f"w{r.doc_id}", r.doc_id, None) for r in out)
