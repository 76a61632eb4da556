"""Streaming ingest: new documents become chunks and postings as they arrive.

Each micro-batch goes to folders named by its number, written anew if the batch is repeated, so
a restart from the checkpoint leaves nothing twice. Term and corpus statistics stay correct, as they
are computed from the postings when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import chunking, retrieval


def ingest(spark: SparkSession, source: str, schema: StructType, store: str, size: int = 1000, overlap: int = 150, text_col: str = "text") -> StreamingQuery:
    """Starts a query from a folder of Parquet files to ``store``; it ends when all is read."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.fixed_size(batch.dropDuplicates(["doc_id"]), size, overlap, text_col)
        chunks.write.mode("overwrite").parquet(f"{store}/chunks/batch={number}")
        kept = spark.read.parquet(f"{store}/chunks/batch={number}")
        retrieval.postings(kept).write.mode("overwrite").parquet(f"{store}/postings/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint")
    return writer.trigger(availableNow=True).start()


def chunks(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/chunks")


def postings(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/postings")
