"""A training corpus from documents, in five stages.

Each stage takes all that its predecessor kept and returns the columns of documents; the last
returns token ids. Between stages the rows are written to the shared folder and read again.

Defined cases of every stage: a null text is an empty one (it scores 0, is a near copy of nothing but other texts
without a word, has nothing to cut and takes no words of the mixture); a very long text is worked through in whole; of
equal rows and of ties the smaller id stays; an empty table gives an empty one; other columns go through
unchanged, also those whose names begin with two underscores, as an operator's own do.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import mixing, pieces, simhash, suffix, toxicity
from docloom.llm.common import guarded, materialize


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Columns of ``docs`` that are named like an operator's own are set aside while the stage runs."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return guarded(lambda d: f(spark, d, sf_dir))(docs)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay. The labels of the same folder train it."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return simhash.keep_one(docs, k=5, similarity=0.8)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut out of the texts."""
    return suffix.clean_texts(docs, length=200)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the order of training."""
    sized = docs.withColumn("__words", mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, "__words", mixing.order_key("doc_id"))
    return mixing.train_order(mixed, "__words", docs.columns).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, little-endian unsigned 32-bit, of each document taken, and its place in training."""
    docs = mixing.rank_in_order(docs).select("position", "doc_id", "source", "text")
    out = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    n_tokens = (F.octet_length("__ids") / 4).cast("long")
    return out.select("doc_id", "source", n_tokens.alias("n_tokens"), F.col("__ids").alias("ids"), "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("source mixture", mix_sources),
    ("sentencepiece ids", encode),
]

ORACLE_SQL = None  # most stages can't be said in SQL; tests hold each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
