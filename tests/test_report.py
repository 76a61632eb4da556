"""Reports of runs and of an ingest against plain computations."""

import statistics

from pyspark.sql import functions as F

from docloom.operators import calls, embed, hooks
from docloom.plans import report

SCHEMA = (
    "pipeline string, qid long, route string, techniques array<string>, context_relevance double, faithfulness double, answer_relevance double, correctness double, "
    "confidence double, n_sources int, n_calls long, input_tokens long, output_tokens long, cost double, latency double"
)


def _row(pipeline, qid, route, techniques, x, cost):
    return (pipeline, qid, route, techniques, x, x, x, None, 0.5, 2, 1, 10 * qid, qid, cost, None)


ROWS = [
    _row("a", 1, "advanced_rag", ["crag", "hyde", "crag"], 0.25, 0.1),
    _row("a", 2, "advanced_rag", ["hyde"], 0.75, 0.2),
    _row("a", 3, "basic_rag", [], None, 0.0),
    _row("b", 1, "basic_rag", None, 1.0, 0.3),
    _row("b", 1, "basic_rag", None, 1.0, 0.3),  # a repeated row counts
]


def _plain():
    groups = {}
    for r in ROWS:
        techniques = sorted(set(r[3] or [])) or [report.NO_TECHNIQUE]
        keys = [("all", None, None, None), ("pipeline", r[0], None, None), ("route", r[0], r[2], None)]
        for k in keys + [("technique", r[0], None, t) for t in techniques]:
            groups.setdefault(k, []).append(r)
    out = {}
    for k, rows in groups.items():
        for i, m in enumerate([*report.METRICS, *report.AMOUNTS], 4):
            v = [r[i] for r in rows if r[i] is not None]
            out[(*k, m)] = (len(rows), len(v), round(sum(v), 6) if v else None, round(statistics.mean(v), 6) if v else None, min(v, default=None), max(v, default=None))
    return out


def test_levels_equal_plain_computation(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for parts in (1, 7):
        got = report.by_levels(df.repartition(parts)).collect()
        assert len(got) == len(_plain())
        assert {(r.level, r.pipeline, r.route, r.technique, r.metric): (r.n_questions, r.n, r.total, r.mean, r.least, r.most) for r in got} == _plain()
    assert report.by_levels(df.limit(0)).collect() == []


def test_levels_move_groups_not_questions(spark):
    """One exchange, after a partial aggregate."""
    plan = report.by_levels(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_sum") > plan.index("Exchange")  # children stand below


def _answers(spark):
    rows = [
        (1, "what is iron", "iron is a metal", "basic_rag", [], "metal is heavy"), (2, "fail", "some context", "advanced_rag", ["hyde"], None), (3, "hello", None, "simple", [], None),
    ]
    df = spark.createDataFrame(rows, "qid long, text string, context string, route string, techniques array<string>, reference string")
    return df.withColumns({"prompt": F.concat("text", F.lit("?")), "system": F.lit("s"), "sources": F.array(F.lit("x"))})


def test_measured_with_a_log_and_a_failing_call(spark, tmp_path):
    def client(system, prompt, key):
        if prompt.startswith("fail"):
            raise OSError("down")
        return "iron is a metal", 1_000_000, 500_000

    llm = calls.LoggedLLM(spark, str(tmp_path / "log"), client, "qwen3-max", attempts=1)
    router = spark.createDataFrame([(1, "router", "qwen3-max", 1_000_000, 0, 0.5, None)], "qid long, step string, model string, input_tokens long, output_tokens long, latency double, error string")
    got = {r.qid: r for r in report.measured(llm.generate(_answers(spark), "system", "prompt", "answer", "qid"), "p", more_calls=router).collect()}
    assert (got[1].n_calls, got[1].input_tokens, got[1].output_tokens, got[1].n_sources) == (2, 2_000_000, 500_000, 1)
    assert abs(got[1].cost - (2 * 1.2 + 0.5 * 6)) < 1e-9 and got[1].latency >= 0.5 and got[1].correctness == 0.571  # 2 * 2 of 4 + 3 words
    assert got[2].faithfulness is None and got[2].answer_relevance is None and got[2].cost == 0 and got[2].input_tokens == 0
    assert got[3].context_relevance == 1 and got[3].correctness is None and got[3].n_calls == 1


def test_measured_without_a_log(spark):
    rows = hooks.MockLLM().generate(_answers(spark).drop("route", "techniques", "reference", "sources"), "system", "prompt", "answer")
    got = report.measured(rows, "p", "qwen3-max").collect()
    assert [r.n_calls for r in got] == [1, 1, 1] and {r.route for r in got} == {"basic_rag"} and all(r.cost > 0 and r.n_sources == 0 for r in got)
    assert report.measured(rows.limit(0), "p").collect() == []


def test_side_by_side(spark):
    one, two = (spark.createDataFrame([_row(p, 1, "basic_rag", [], x, c)], SCHEMA) for p, x, c in (("a", 0.5, 0.4), ("b", 0.25, 0.1)))
    (r,) = report.side_by_side(one, two).collect()
    assert (r.delta_faithfulness, r.delta_correctness, r.delta_cost) == (0.25, None, 0.3)


def test_ingest_counts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One paragraph.\n\nAnother one.")
    (tmp_path / "b.md").write_text("# Head\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"left out")
    chunks, errors, counts = report.ingest(spark, str(tmp_path), "recursive", embed.HashingEmbedder())
    rows = chunks.collect()
    assert counts["files"] == {"txt": 1, "markdown": 1, "docx": 1, "pdf": 1}
    assert (counts["elements"], counts["tables"], counts["headings"], counts["errors"]) == (5, 1, 1, 2)
    assert counts["chunks"] == len(rows) > 0 and counts["chars"] == sum(len(r.text) for r in rows)
    assert errors.count() == 2 and all(r._error for r in errors.collect())
