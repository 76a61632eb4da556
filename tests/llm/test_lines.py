import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import lines, queries

SPACES = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(lines.UPPER, lines.LOWER)


def brute(texts, min_docs, min_chars=1, keep_first=False):
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(SPACES).translate(FOLD) for x in doc] for doc in split]
    docs = {}
    for i, doc in enumerate(keys):
        for k in doc:
            docs.setdefault(k, set()).add(i)
    out, seen = [], set()
    for doc, ks in zip(split, keys):
        kept = []
        for line, k in zip(doc, ks):
            bad = k != "" and len(k) >= min_chars and len(docs[k]) >= min_docs
            if not bad or keep_first and k not in seen:
                kept.append(line)
            seen.add(k)
        out.append((len(doc), len(doc) - len(kept), "\n".join(kept)))
    return out


def corpus(n=400):
    r = random.Random(4)
    common = [f"Common Line {i}" for i in range(6)]
    texts = [None, "", "\n", "\n\n  \n", "common line 0", "COMMON LINE 0\n\tcommon line 0\x0b", "É line", "é line", "a ", "a"]
    for i in range(n):
        doc = [f"own {i} {j}" for j in range(r.randint(0, 6))]
        doc += [r.choice(common[: 1 + r.randrange(6)]) + r.choice(["", " ", "\t"]) for _ in range(r.randint(0, 3))]
        doc += [f"pair {i // 3}"] * r.randint(0, 2) + [""] * r.randint(0, 2)
        r.shuffle(doc)
        texts.append("\n".join(doc))
    texts += [texts[20]] * 12 + ["é line"] * 9
    texts.append("\n".join(["common line 1", "x"] * 5000 + [f"long {i}" for i in range(9000)] + ["common line 2"]))
    return texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = corpus()
    d = str(tmp_path_factory.mktemp("lines"))
    rows = [(i if i != 15 else 14, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5).write.parquet(f"{d}/documents.parquet")
    return d, texts


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 1), (1, 8), (3, 30)])
def test_equals_brute_force(spark, folder, min_docs, min_chars):
    d, texts = folder
    got = lines.drop_lines(spark.read.parquet(f"{d}/documents.parquet"), min_docs=min_docs, min_chars=min_chars).collect()
    want = brute(texts, min_docs, min_chars)
    assert {r.n: (r["__n_lines"], r["__n_dropped"], r.text) for r in got} == dict(enumerate(want))


def test_first_occurrence_stays(spark):
    texts = corpus(60)
    # one file, so that documents come in the order of their rows
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").coalesce(1)
    got = {r.n: r.text for r in lines.drop_lines(df, min_docs=1, keep_first=True).collect()}
    assert got == {i: x[2] for i, x in enumerate(brute(texts, 1, keep_first=True))}


def test_bitmaps_hold_no_text_and_give_it_back(spark, folder):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    maps = lines.line_bitmaps(docs)
    assert maps.columns == ["doc_id", "n", "__n_lines", "__n_dropped", "__bitmap"]
    by = {r.n: r for r in maps.collect()}
    assert not by[11]["__bitmap"] or all(0 <= w.word <= len(texts[11]) // 64 for w in by[11]["__bitmap"])
    longest = by[len(texts) - 1]
    assert longest["__n_lines"] == 19001 and longest["__n_dropped"] == 5001 and len(longest["__bitmap"]) == 10000 // 64 + 2
    both = docs.join(maps.select("n", "__bitmap"), "n").select("n", lines.kept_text(F.col("text"), F.col("__bitmap")).alias("t"))
    assert {r.n: r.t for r in both.collect()} == {i: x[2] for i, x in enumerate(brute(texts, 10))}


def test_query_equals_sql_and_brute_force(spark, folder):
    d, texts = folder
    got = sorted(map(tuple, queries.op12_line_dedup(spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(lines.sql()).fetchall())
    ids = [i if i != 15 else 14 for i in range(len(texts))]
    assert got == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in zip(ids, brute(texts, 10)))


def test_nothing_moves_for_first_occurrences_and_columns_clash(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lines.occurrences(lines._tagged(docs), "text")
    plan = lines.repeated(lines._ranged(rows), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning") == 1  # the ranges, then one row of each
    clash = docs.withColumns({"__key": F.lit("k"), "__at": F.lit(7), "__row": F.lit(1), "__n_lines": F.lit("mine")})
    out = lines.drop_lines(clash)
    assert sorted(out.columns) == sorted(clash.columns + ["__n_dropped"])
    assert {(r["__key"], r["__at"], r["__row"]) for r in out.collect()} == {("k", 7, 1)} and dict(out.dtypes)["__n_lines"] == "bigint"
    assert lines.drop_lines(docs.limit(0)).count() == 0 and lines.line_bitmaps(docs.limit(0)).count() == 0


def test_small_tables_are_few_files(spark, folder, monkeypatch):
    d, texts = folder
    files, write = {}, lines.materialize

    def seen(df, name):
        out = write(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(lines, "materialize", seen)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.n: r.text for r in lines.drop_lines(spark.read.parquet(f"{d}/documents.parquet"), min_docs=2).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: x[2] for i, x in enumerate(brute(texts, 2))}
    cores = spark.sparkContext.defaultParallelism
    assert files["lines-often"] <= cores and files["lines-bitmaps"] <= cores


def test_only_a_to_z_change_in_keys(spark):
    odd = "ÀÉÞßİIıKKÅÅſΣςσǅⅣⓐⒶЖႠꭰＡ𐐀"  # among them what lower() makes ASCII or longer
    words = [a + x + b for x in odd for a in ("", "A", "ab ") for b in ("", "Z", "\x1fQ ")] + ["PLAIN", "\tMiXed [@`{] ", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", lines.line_key(F.col("w")).alias("k")).collect()
    assert {r.w: r.k for r in got} == {w: w.strip(SPACES).translate(FOLD) for w in words}
