"""Calls of models with a log: each prompt is sent once, failures become rows.

A call is known by the hash of model, system text and prompt. What the log has is not sent again, whether it comes from
an earlier run or from another question with the same prompt. New prompts go out in waves; a wave's replies are
in the log before the next begins, and a task has at most ``task_calls`` prompts, so a lost executor repeats at most
those. The client also gets the hash, for services that take such a key to bill a repeat once.

A failing call is tried ``attempts`` times with a doubling wait; then its row has ``error`` and no reply, and no task fails.
Failed calls are sent again by the next run.

Defined cases: a null prompt or one without a character that is not blank is not sent and gets null; repeated prompts
are sent once and bill the first question (by id) that asks; a client that returns no counts gets a quarter of the characters; an
empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hooks
from .written import written

#: system text, prompt, key -> reply, input tokens, output tokens (None where not counted)
Client = Callable[[str, str, str], tuple[str, int | None, int | None]]
LOG = "key string, model string, reply string, input_tokens long, output_tokens long, latency double, attempts int, error string"


class LoggedLLM:
    """An ``LLM`` over a client. ``path``: the folder of the log, which the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str, client: Client, model: str, attempts: int = 3, wait: float = 1.0, task_calls: int = 16, wave_calls: int = 4096):
        self.spark, self.path, self.client, self.model = spark, path.rstrip("/"), client, model
        self.attempts, self.wait, self.task_calls, self.wave_calls = max(1, attempts), wait, task_calls, wave_calls

    def log(self) -> DataFrame:
        """All calls that were made, the failed ones too."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def _key(self, system: str, prompt: str):
        text = F.coalesce(F.col(prompt), F.lit(""))
        return F.when(text.rlike(r"\S"), F.sha2(F.to_json(F.struct(F.lit(self.model).alias("m"), F.coalesce(F.col(system), F.lit("")).alias("s"), text.alias("p"))), 256))

    def _send(self, prompts: DataFrame) -> None:
        client, model, attempts, wait = self.client, self.model, self.attempts, self.wait

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, system, prompt in batch.itertuples(index=False):
                    began, tries, error, got = time.monotonic(), 0, None, (None, None, None)
                    while tries < attempts:
                        tries += 1
                        try:
                            got, error = client(system, prompt, key), None
                            break
                        except Exception as e:  # noqa: BLE001  a failed call is a row
                            error = f"{type(e).__name__}: {e}"
                            if tries < attempts:
                                time.sleep(wait * 2 ** (tries - 1))
                    row = [(key, model, got[0], got[1], got[2], time.monotonic() - began, tries, error)]
                    yield pd.DataFrame(row, columns=[c.split()[0] for c in LOG.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

        sent = prompts.select("key", "system", "prompt").mapInPandas(run, LOG)
        sent.write.mode("append").parquet(self.path)

    def _missing(self, asked: DataFrame) -> DataFrame:
        return asked.join(self.log().filter("error is null").select("key"), "key", "left_anti")

    def generate(self, df: DataFrame, system: str, prompt: str, out: str, order: str | None = None) -> DataFrame:
        """``df`` plus ``out`` and ``out_call``: a struct of model, tokens, latency, attempts, error, and ``billed``, whether this
        row is the one that the call was made for (the first by ``order``, or any)."""
        rows = df if system in df.columns else df.withColumn("system", F.lit(system))
        name = system if system in df.columns else "system"
        rows = written(rows.withColumn("call_key", self._key(name, prompt)), "calls")
        asked = rows.filter("call_key is not null").groupBy(F.col("call_key").alias("key")).agg(F.first(F.coalesce(name, F.lit(""))).alias("system"), F.first(prompt).alias("prompt"))
        asked = written(self._missing(asked), "calls-missing")
        total = asked.count()
        waves = -(-total // self.wave_calls)
        for i in range(waves):
            part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == i)
            self._send(part.repartition(max(1, -(-min(total, self.wave_calls) // self.task_calls)), "key"))
        best = Window.partitionBy("key").orderBy(F.col("error").isNotNull(), F.desc("attempts"))
        log = self.log().join(rows.select(F.col("call_key").alias("key")).distinct(), "key", "left_semi")
        log = log.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
        first = Window.partitionBy("call_key").orderBy(F.col(order) if order else F.lit(0))
        rows = rows.withColumn("call_nth", F.row_number().over(first))
        both = rows.join(log.withColumnRenamed("key", "call_key"), "call_key", "left")
        used = lambda n, text: F.when(F.col("reply").isNotNull(), hooks.usage_fallback(F.col(n), F.col(text)))
        call = F.struct(
            "model", used("input_tokens", prompt).alias("input_tokens"), used("output_tokens", "reply").alias("output_tokens"), "latency", "attempts", "error",
            (F.col("call_nth") == 1).alias("billed"),
        )
        return both.select(*df.columns, F.col("reply").alias(out), F.when(F.col("call_key").isNotNull(), call).alias(f"{out}_call"))


def call_rows(answers: DataFrame, out: str, step: str, id_col: str = "qid") -> DataFrame:
    """``(qid, step, model, input_tokens, output_tokens, latency, error)`` of the calls that answers were made with, each once:
    what ``evaluation.costs`` prices."""
    call = F.col(f"{out}_call")
    rows = answers.filter(call.isNotNull() & call["billed"])
    return rows.select(F.col(id_col).alias("qid"), F.lit(step).alias("step"), *(call[c].alias(c) for c in ("model", "input_tokens", "output_tokens", "latency", "error")))
