"""Empty tables, very long texts, ties and several segments, and the query of pieces against whole-text encoding."""

import struct
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import mixing, pieces, quality, queries, simhash, tokens
from tests.llm.test_pieces import plain

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_op3_query(spark):
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op3_sentencepiece(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    short = 0
    for i, t in texts.items():
        data = v.encode(t) if t else b""
        if t and len(t) < 1500:
            short += 1
            assert np.frombuffer(data, "<u4").tolist() == plain(v, t)
        want = (len(data) // 4, zlib.crc32(data), len(t), True)
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].decoded_chars, got[i].round_trip) == want
    assert short > 50


def test_op3_giant_text_in_chunks_of_the_real_size(spark):
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = "".join(f"word{i % 977} of {i} " for i in range(30_000)) + "x" * 70_000
    assert len(text) > 8 * pieces.CHUNK
    df = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    got = {r.doc_id: bytes(r["__ids"]) for r in pieces.encode_texts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1] == v.encode(text) and got[2] == v.encode("short one")


def test_op4_several_segments_in_a_task_and_a_text_longer_than_one(spark, tmp_path):
    lib = Tokenizer.from_file(WORDS)
    rows = [(i, f"number {i} and so on " * (500 + 7000 * (i % 3))) for i in range(30)] + [(30, "a giant of a text " * 60_000), (31, None), (32, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ids")
    tokens.write_ids(df, path, WORDS)
    files = spark.read.parquet(path)
    assert files.agg(F.max("segment")).first()[0] > 0 and files.agg(F.max("n_ids")).first()[0] > tokens.SEGMENT_IDS
    start = 0
    for r, (i, t) in zip(sorted(tokens.read_ids(spark, path).collect(), key=lambda x: x[0]), rows):
        want = lib.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        assert tuple(r)[:3] == (i, start, len(want)) and list(struct.unpack(f"<{len(want)}I", bytes(r[3]))) == want
        start += len(want)


def test_op6_empty_table_and_ties_across_sources(spark):
    schema = "doc_id long, source string, size long"
    order = lambda df: mixing.first_order(mixing.mix(df, "size", mixing.order_key("doc_id")), "size")
    assert order(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, s, 4) for i in range(40) for s in ("a", "b", None)]  # equal ids, sizes and keys in each source
    got = [order(spark.createDataFrame(rows, schema).repartition(n)).collect() for n in (2, 7)]
    seen = [sorted((r.doc_id, r.source or "", r["__copies"], r["__position"]) for r in x) for x in got]
    assert seen[0] == seen[1] and len(seen[0]) == 120


def test_op7_empty_table_and_a_very_long_text(spark):
    schema = "doc_id long, text string"
    assert quality.judge(spark.createDataFrame([], schema)).count() == 0
    n = 60_000
    text = "\n".join(f"Line {i} says that {i * 7} things are here, and no more of them than that today." for i in range(n))
    (r,) = quality.judge(spark.createDataFrame([(1, text)], schema)).collect()
    assert r["__n_words"] == len(text.split()) == 16 * n and r["__n_dup_lines"] == 0
    assert r["__word_chars"] == sum(map(len, text.split())) and r["__n_repeat_words"] > 0


def test_op8_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string"), k=3, max_bits=2).count() == 0
