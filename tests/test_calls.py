import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import calls, evaluation
from docloom.plans import pipelines


def client_of(folder, fails=lambda prompt, tries: False):
    """Replies with the prompt's end; notes each call as a file of the folder."""

    def client(system, prompt, key):
        tries = sum(n.startswith(key) for n in os.listdir(folder)) + 1
        open(f"{folder}/{key}-{tries}", "w").close()
        if fails(prompt, tries):
            raise TimeoutError("no answer")
        return f"re: {prompt[-8:]}", len(prompt) if "counted" in prompt else None, None

    return client


@pytest.fixture
def places(tmp_path):
    (tmp_path / "made").mkdir()
    return str(tmp_path / "made"), f"file://{tmp_path}/log"


def frame(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "qid long, prompt string").repartition(3)


def test_each_prompt_is_sent_once(spark, places):
    made, log = places
    llm = calls.LoggedLLM(spark, log, client_of(made), "gemini-2.5-flash-lite", wave_calls=7, task_calls=2)
    rows = frame(spark, [f"prompt {i % 20} counted" if i % 2 else f"prompt {i % 20}" for i in range(40)] + [None, "  "])
    got = {r.qid: r for r in llm.generate(rows, "be brief", "prompt", "answer", "qid").collect()}
    assert len(os.listdir(made)) == 20 and len(got) == 42
    assert all(got[i].answer == f"re: {(f'prompt {i % 20} counted' if i % 2 else f'prompt {i % 20}')[-8:]}" for i in range(40))
    assert got[40].answer is None and got[41].answer_call is None
    assert [i for i in range(40) if got[i].answer_call.billed] == list(range(20))
    assert got[1].answer_call.input_tokens == len("prompt 1 counted") and got[2].answer_call.input_tokens == len("prompt 2") // 4
    again = calls.LoggedLLM(spark, log, client_of(made), "gemini-2.5-flash-lite").generate(rows, "be brief", "prompt", "answer", "qid")
    assert again.filter("answer is not null").count() == 40 and len(os.listdir(made)) == 20
    priced = evaluation.costs(calls.call_rows(again, "answer", "final_generation"))
    assert priced.count() == 20 and {r.technique for r in priced.collect()} and evaluation.latest_calls(priced).count() == 20
    assert calls.LoggedLLM(spark, log, client_of(made), "another").generate(rows.limit(1), "be brief", "prompt", "answer").count() == 1
    assert len(os.listdir(made)) == 21 and llm.generate(rows.limit(0), "x", "prompt", "answer").count() == 0


def test_flaky_and_failing_calls_are_rows(spark, places):
    made, log = places
    fails = lambda prompt, tries: "never" in prompt or "flaky" in prompt and tries < 3
    llm = calls.LoggedLLM(spark, log, client_of(made, fails), "m", attempts=3, wait=0.01)
    rows = frame(spark, ["good", "flaky one", "never works"])
    got = {r.qid: r for r in llm.generate(rows, "", "prompt", "answer").collect()}
    assert [got[i].answer_call.attempts for i in range(3)] == [1, 3, 3] and [got[i].answer is None for i in range(3)] == [False, False, True]
    assert got[2].answer_call.error == "TimeoutError: no answer" and got[2].answer_call.input_tokens is None and len(os.listdir(made)) == 7
    healed = calls.LoggedLLM(spark, log, client_of(made), "m")
    got = {r.qid: r for r in healed.generate(rows, "", "prompt", "answer").collect()}
    assert got[2].answer == "re: er works" and got[2].answer_call.error is None and len(os.listdir(made)) == 8  # only what had failed


def test_answers_bring_their_calls(spark, places):
    made, log = places
    chunks = spark.createDataFrame([("a", "apples grow on trees"), ("b", "ships sail on seas")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "apples", None), (2, "ships", None), (3, "ships", None)], "qid long, text string, generated array<string>")
    llm = calls.LoggedLLM(spark, log, client_of(made, lambda p, t: "<question>\napples" in p), "m", wait=0.01)
    out = pipelines.answer(asked, chunks, 1, llm)
    report = calls.call_rows(out, "answer", "final_generation").collect()
    assert {r.qid for r in report if r.error} == {1} and sum(r.error is None for r in report) == 1  # the same prompt is billed once
    assert out.filter(F.col("qid") > 1).select("answer").distinct().count() == 1
