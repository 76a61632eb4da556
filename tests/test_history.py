import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed as X  # noqa: F401
from docloom.operators import context
from docloom.plans import pipelines
from docloom.streaming import history


def corpus():
    r = random.Random(8)
    rows = []
    for conv, n in ((1, 3000), (2, 7), (3, 1), (4, 12)):  # one holds nearly all rows
        for t in range(n):
            text = None if t % 11 == 5 else "w" * r.choice([0, 3, 20, 90, 400])
            rows.append((conv, t * 2, "user" if t % 2 == 0 else "assistant", text))
    return rows


def brute(rows, budget):
    out, by = {}, {}
    for conv, turn, role, text in rows:
        if role == "user":
            left, kept = budget, []
            for past in reversed(by.get(conv, [])):
                if len(past[1] or "") + 1 > left:
                    break
                left -= len(past[1] or "") + 1
                kept.insert(0, past)
            out[conv, turn] = kept
        by.setdefault(conv, []).append([role, text])
    return out


@pytest.mark.parametrize("budget", [1, 100, 5000])
def test_history_within_a_budget_equals_brute_force(spark, budget):
    rows = corpus()
    df = spark.createDataFrame(rows + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.turn): [[m.role, m.content] for m in r.history] for r in context.recent_history(df, budget).collect()}
    assert got == brute(rows, budget)
    assert context.recent_history(df.limit(0), budget).count() == 0


def test_a_stream_gives_the_same_and_goes_on_after_a_restart(spark, tmp_path):
    rows = [x for x in corpus() if x[0] != 1] + [x for x in corpus() if x[0] == 1][:60]
    schema = "conv_id long, turn long, role string, text string"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = history.histories(stream, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()

    half = [x for x in rows if x[1] < 12]
    run(half, "a")
    run([x for x in rows if x[1] >= 12] + half[:5], "b")  # a new query from the checkpoint; some turns come twice
    got = spark.read.parquet(out).collect()
    assert len(got) == len({(r.conv_id, r.turn) for r in got})
    assert {(r.conv_id, r.turn): json.loads(r.history) for r in got} == brute(rows, 100)


def test_history_reaches_the_prompt(spark):
    class Recorder:
        def generate(self, df, system, prompt, out):
            return df.withColumn(out, F.col(prompt))

    chunks = spark.createDataFrame([("a", "apples grow on trees")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "apples", None, [("user", "hi"), ("assistant", None)]), (2, "apples", None, None)], "qid long, text string, generated array<string>, history array<struct<role:string,content:string>>")
    got = {r.qid: r.answer for r in pipelines.answer(asked, chunks, 1, Recorder()).collect()}
    assert got[1] == "user: hi\nassistant: \n\n" + got[2]
