import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.suffix import clean_texts, remove_repeats


def brute(texts, length):
    where = {}
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            where.setdefault(d[p : p + length], []).append((i, p))
    gone = [bytearray(len(d)) for d in data]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for d, g in zip(data, gone):
        kept = bytes(x for x, y in zip(d, g) if not y)
        spans = sum(1 for j, y in enumerate(g) if y and (j == 0 or not g[j - 1]))
        out.append((len(d), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(20, 90))) for _ in range(6)]
    texts = [None, "", "short", "a" * 900, "ab" * 300, "a" * 199, "line of text\n" * 40]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            if r.random() < 0.5:  # an edit
                k = r.randrange(len(p))
                p = p[:k] + r.choice("xyz") + p[k + 1 :]
            if r.random() < 0.4:
                p = p[r.randrange(len(p)) :]
            parts += [p, word()]
        texts.append(" ".join(parts))
    return texts + texts[20:24] + [texts[30] + "!"]


@pytest.mark.parametrize("seed,length", [(1, 200), (2, 200), (3, 110)])
def test_equals_brute_force(spark, seed, length):
    texts = made(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    out = remove_repeats(df, length=length).select(
        "doc_id", "__n_bytes", "__n_removed", "__n_spans", F.sha2("__kept", 256).alias("h")
    )
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_empty_table_and_other_columns(spark):
    text = "one two three " * 5 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    df = spark.createDataFrame([(1, text, 5, "t"), (1, text, 5, None), (None, "x", 1, "c")], "doc_id long, text string, n int, t string")
    rows = clean_texts(df).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["x", "", ""] and rows[0].asDict().keys() == {"doc_id", "text", "n", "t"}
    assert clean_texts(df.limit(0)).count() == 0


def test_texts_longer_than_a_piece(spark):
    r = random.Random(9)
    body = "".join(r.choices("abcdefghijklmnop ", k=2_300_000))
    df = spark.createDataFrame([(1, "#" + body), (2, body + "!"), (3, "lonely " * 9)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in clean_texts(df).collect()}
    assert got == {1: "#", 2: "!", 3: "lonely " * 9}
