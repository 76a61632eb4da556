import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import toxicity

BAD = ("vilething", "rottenling", "vileword", "rottenbit")


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 25))]
        bad = r.random() < 0.15
        if bad:
            k = r.randrange(len(lines))
            lines[k] += " " + r.choice(BAD) + r.choice(["", ",", "s"]) + " " + word()
        rows.append((i, ".\n".join(lines) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_blame(spark):
    rows, labels = corpus(2500, 1)
    truth = dict(labels)
    rows += [(5000, None), (5001, ""), (None, "nothing here"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).withColumn("out", toxicity.held_out()).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "__score", "__offending", "out"}
    by = {r.doc_id: r for r in got}
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert by[5000]["__score"] == by[5001]["__score"] == 0 and all(0 <= r["__score"] <= 1 for r in got)
    test = [r for r in got if r.out and r.doc_id in truth]
    wrong = [r for r in test if (r["__score"] >= 0.3) != truth[r.doc_id]]
    assert len(test) > 400 and len(wrong) <= 0.02 * len(test)
    found = [r for r in test if truth[r.doc_id] and r["__offending"]]
    right = [r for r in found if any(w in toxicity.sentences(r.text)[r["__offending"][0]] for w in ("vile", "rotten"))]
    assert len(right) >= 0.95 * len(found) > 30


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r["__score"] < 1e-6 for r in toxicity.score(docs, model).collect()] == [True]
    assert toxicity.score(docs.limit(0), model).count() == 0
    only = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert 0 <= toxicity.score(docs, toxicity.train(docs, only)).first()["__score"] <= 1


def test_a_very_long_labelled_text_does_not_spoil_the_model(spark):
    rows, labels = corpus(600, 3)
    long = [(i, "endless words without harm. " * 3000) for i in range(700, 704)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i, 0) for i, _ in long], "doc_id long, toxic int")
    # each of the long texts would use up all that the others are given
    model = toxicity.train(docs, marks, max_chars=2_000_000, row_chars=50_000, min_chi=5.0)
    plain = toxicity.train(docs.filter("doc_id < 700"), marks, min_chi=5.0)
    assert model.weights and model.weights.keys() == plain.weights.keys() and abs(model.bias - plain.bias) < 1e-6
    tight = toxicity.train(docs, marks, max_chars=60_000, min_chi=1.0)
    assert tight.bias > -60 and tight.weights
