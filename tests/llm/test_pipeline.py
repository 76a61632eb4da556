import random

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import pieces

WORDS = "amber birch cedar delta ember frost grove heath ivory jetty knoll larch maple north olive".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n)) + "."
    passage = line(70)
    rows, labels = [], []
    for i in range(600):
        text = "\n".join(line(r.randint(5, 30)) for _ in range(r.randint(2, 9)))
        if i % 10 == 3:
            text += "\nyou vileperson " + line(4)
        if i % 10 == 5:
            text = rows[i - 1][1]  # a copy
        if i % 10 == 6:
            text = rows[i - 1][1].replace(".", " extra.", 1) if len(rows[i - 1][1].split()) > 70 else text
        if i % 10 == 8:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 10 == 3)))
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0), (1, *rows[1][1:])]
    d = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, passage


def test_each_stage_does_its_part(spark, folder):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        seen.append(docs.collect())
        if name != "sentencepiece ids":
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1], docs.schema)
    clean, single, cut, mixed, ids = seen
    assert {x.doc_id for x in clean} == {x[0] for x in rows if x[0] >= 600 or x[0] % 10 != 3}
    kept = [x.doc_id for x in single]
    assert len(set(kept)) == len(kept) and not any(i % 10 == 5 and i < 600 for i in kept)
    assert all(x in kept for x in range(600) if x % 10 in (0, 1, 2, 4, 7, 8, 9))
    assert all(passage not in (x.text or "") for x in cut) and len(cut) == len(single)
    untouched = {x.doc_id: x.text for x in cut if x.doc_id % 10 != 8}
    assert all(untouched[i] == x[1] for i, x in enumerate(rows[:600]) if i in untouched)
    assert {x.source for x in mixed} >= {"s0", "s1", "s2"} and max(map([x.doc_id for x in mixed].count, set(kept))) <= 3
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = {x.doc_id: x.text for x in cut}
    assert sorted(x.doc_id for x in ids) == sorted(x.doc_id for x in mixed)
    assert all(v.decode(np.frombuffer(bytes(x.ids), "<u4")) == (text[x.doc_id] or "") for x in ids)


def test_run_equals_the_stages(spark, folder):
    d = folder[0]
    out = corpus_pipeline.run(spark, d)
    again = corpus_pipeline.run(spark, d)
    key = [F.count("*"), F.sum("n_tokens"), F.sum(F.xxhash64("doc_id", "ids").cast("decimal(38,0)"))]
    assert out.agg(*key).first() == again.agg(*key).first() and out.count() > 100
