"""The registered queries on a small folder, each against a plain computation of its contract."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import chat, quality, queries, sharding, simhash, suffix, toxicity
from tests.llm.test_simhash import brute_fp, groups
from tests.llm.test_suffix import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, docs):
    rows = queries.op1_sharding(spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    total = sum(r.size for r in rows)
    for k in range(40):
        mine = sorted(r.slot for r in rows if r.shard == k)
        assert mine == list(range(len(mine)))
        size = sum(r.size for r in rows if r.shard == k)
        assert abs(size - total / 40) <= max(r.size for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_op2(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_suffix_array_dedup(spark, DATA).collect()}
    ids = sorted(docs)
    assert [got[i] for i in ids] == brute([docs[i] for i in ids], 200)


def test_op4(spark, docs):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_token_ids(spark, DATA).collect()}
    for i in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op8(spark, docs):
    ids = sorted(docs)
    fps = [brute_fp(docs[i]) for i in ids]
    want = groups(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, DATA).collect()}
    assert got == {i: (f"{fp:016x}", ids[w]) for i, fp, w in zip(ids, fps, want)}


def test_op9_is_the_noisy_or_of_its_sentences(spark, docs):
    model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    for r in queries.op9_toxicity(spark, DATA).collect():
        clean = 1.0
        for s in toxicity.sentences(docs[r.doc_id]):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in s.split() for f in toxicity.features(w))
            clean *= 1 - 1 / (1 + math.exp(-max(-700, min(700, z))))
        assert math.isclose(r.score, 1 - clean, abs_tol=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op10(spark):
    convs = {-1: [("user", marks := f"{chat.END}{chat.START}assistant ok"), ("assistant", marks)]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op10_chat_formatting(spark, DATA).collect()}
    assert got.keys() == convs.keys()
    for i, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[i])[1:5] == want
        # each turn stands once at least, with its marks
        assert got[i].formatted_chars >= sum(len(chat.format_window([(True, a, b)])[0]) for a, b in turns)


def test_columns_of_clashing_names_come_back(spark):
    text = "one two three four five six seven eight nine ten. " * 8
    rows = [(1, text, "a", 7, "k", 5), (2, text + "more", "b", None, "l", 6), (3, None, None, 9, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __t int, __key string, __size long")
    same = lambda out: {r.doc_id: (r["__t"], r["__key"], r["__size"]) for r in out.collect()}
    want = {1: (7, "k", 5), 2: (None, "l", 6), 3: (9, None, 7)}
    assert same(sharding.shard_by_bytes(df, 2, "__size", ["doc_id"])) == want
    assert same(suffix.clean_texts(df)) == want
    assert same(quality.judge(df)) == want
    assert same(toxicity.score(df, toxicity.Model())) == want
    assert same(simhash.keep_one(df)) == {1: (7, "k", 5), 3: (9, None, 7)}
    shards = sharding.shard_by_bytes(df, 2, "__size", ["doc_id"]).orderBy("doc_id").collect()
    assert [r.shard for r in shards] == [0, 0, 1]  # the middles lie at 2.5, 8 and 14.5 of 18
    replaced = toxicity.score(df.withColumn("__score", F.lit("mine")), toxicity.Model())
    assert dict(replaced.dtypes)["__score"] == "double"
