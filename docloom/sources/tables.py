"""Tables as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt to all cores by ``key`` where it is read in fewer parts than there are cores. A small
    file often holds one row group, which one task would work through alone. Each part has at most
    spark.sql.files.maxPartitionBytes, so what moves is bounded by the cores; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(cores, key)


def table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """A Parquet table of ``folder``; with ``key``, by ``spread``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, key) if key else df
