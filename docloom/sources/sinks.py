"""Stores of chunks and sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = (
    "id", "route", "techniques", "context_relevance", "faithfulness", "answer_relevance", "correctness", "total_cost",
    "latency",
)


def add(chunks: DataFrame, path: str, dim: int) -> None:
    """Appends chunks to a store; vectors of another length are an error."""
    right = F.assert_true(F.size("vector") == dim, F.lit(f"vectors must have {dim} components"))
    chunks.filter(right.isNull()).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def save_csv(results: DataFrame, path: str) -> None:
    rows = results.withColumn("techniques", F.array_join("techniques", ","))
    rows.select(*RESULT_COLUMNS).write.mode("overwrite").csv(path, header=True)
