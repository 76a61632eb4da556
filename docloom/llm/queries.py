"""The registered queries of this subpackage: each reads a whole table through its operator and
returns the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, lines, mixing, negatives, pieces, quality, tokens, toxicity, whitening
from .common import materialize, new_path
from .sharding import shard_by_bytes
from .simhash import simhash_components
from .suffix import remove_repeats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    return shard_by_bytes(docs, 40, "size", ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, "text", length=200)
    return out.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", F.sha2(F.regexp_replace(text, pieces.BLANK, " ").cast("binary"), 256).alias("want"))
    return pieces.encode_texts(docs, model, decode=True).select(
        "doc_id",
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.col("__ids_crc32").alias("ids_crc32"),
        F.length("__decoded").cast("long").alias("decoded_chars"),
        (F.sha2(F.col("__decoded").cast("binary"), 256) == F.col("want")).alias("round_trip"),
    )


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-ids")
    tokens.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_ids(spark, path, digest=True).withColumnRenamed("id", "doc_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embeddings.near_vectors(rows, least=0.98).withColumnRenamed("id", "vec_id")


def op6_mixing_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = materialize(docs, "mixture-sizes")  # counted once, read by each sum
    # rows come in the order in which training first reaches them
    out = mixing.first_order(mixing.mix(docs, "size", mixing.order_key("doc_id")), "size")
    return out.select(
        "doc_id",
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("size") * F.col("__copies")).alias("taken"),
        F.when(F.col("__copies") > 0, F.bround("__position", 9)).alias("first_position"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return quality.judge(docs).select("doc_id", *(F.col(f"__{x}").alias(x) for x in names))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("__offending").alias("offending_sentences"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash_components(docs, k=3, max_bits=2)
    return out.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = f"{chat.END}{chat.START}assistant ok"
    fixture = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    path = new_path(spark, "chat")
    chat.windows(turns.unionByName(fixture)).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, components=32).withColumnRenamed("id", "vec_id")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.drop_lines(docs, min_docs=10, min_chars=1)
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_ids": op4_token_ids,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_mixing_target_weights": op6_mixing_target_weights,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op5_embedding_near_dedup": embeddings.sql(),
    "op6_mixing_target_weights": mixing.sql(),
    "op7_quality_rules": quality.sql(),
    "op12_line_dedup": lines.sql(),
    "op13_hard_negatives": negatives.sql(),
}
