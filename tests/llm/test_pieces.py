import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from docloom.llm import pieces as P
from docloom.llm.common import slices

PATH = public_tokenizers.path("piece_bpe_32k.model")


def field(data, number):
    """(start, end) of the first field of a protobuf message, with its tag's start."""
    i = 0
    while i < len(data):
        tag_at = i
        tag, i = varint(data, i)
        if tag & 7 == 0:
            value, j = varint(data, i)
        elif tag & 7 == 2:
            size, i = varint(data, i)
            j = i + size
        else:
            j = i + (8 if tag & 7 == 1 else 4)
        if tag >> 3 == number:
            return tag_at, i, j
        i = j


def varint(data, i):
    out = shift = 0
    while True:
        out |= (data[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if data[i - 1] < 128:
            return out, i


def unigram_library():
    """The library's unigram encoder on the same pieces and scores."""
    data = bytearray(open(PATH, "rb").read())
    _, a, b = field(data, 2)
    _, x, _ = field(data[a:b], 3)
    data[a + x] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def plain(v, text):
    """All of the lattice at once."""
    s = P.normal(text)
    score, back = [0] + [P.LOW] * len(s), [0] * (len(s) + 1)
    for b in range(1, len(s) + 1):
        for a in range(max(0, b - v.reach), b):
            x = v.pieces.get(s[a:b], (0, None))[1]
            if x is None and b == a + 1:
                x = v.unknown
            if x is not None and score[a] + x > score[b]:
                score[b], back[b] = score[a] + x, a
    cuts = [len(s)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    cuts.reverse()
    return [i for a, b in zip(cuts, cuts[1:]) for i in v.ids_of(s[a:b])]


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeghinorstéü") for _ in range(r.randint(1, 12)))
    out = ["a", " ", "  two  blanks ", "x\ny", "日本🙂", "end ", "▁odd", "a" * 700, "ab" * 400 + "日" * 50]
    out += [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(30)]
    out += ["".join(word() for _ in range(90)) + " " + word() + "\n" + "b" * 200]
    return out


def test_ids_are_the_best_way_and_decode(spark):
    v = P.vocabulary(PATH)
    lib = unigram_library()
    for t in texts():
        ids = np.frombuffer(v.encode(t), "<u4")
        assert ids.tolist() == plain(v, t)
        assert v.decode(ids) == t.replace("▁", " ")
        if "  " not in t and re.fullmatch(r"[a-z ]*", t) and len(t) < 1000:  # sums exact in 32-bit floats
            assert ids.tolist() == lib.encode(t)


@pytest.mark.parametrize("chunk", [16, 33, 100])
def test_chunks_give_the_same_ids(spark, chunk):
    v = P.vocabulary(PATH)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(0, None, 2), (1, "", 2), (None, "a" * 700, 3), (7, "a" * 700, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int").repartition(3)
    got = P.decode_ids(P.encode_texts(df, PATH, chunk=chunk), PATH).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "t", "__ids", "__decoded", "__ids_crc32"}
    for r in got:
        want = plain(v, r.text) if r.text else []
        assert np.frombuffer(bytes(r["__ids"]), "<u4").tolist() == want
        assert r["__decoded"] == (r.text or "").replace("▁", " ")
    both = P.encode_texts(df, PATH, chunk=chunk, decode=True).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.t)
    assert sorted(both, key=key) == sorted(got, key=key)
    assert P.encode_texts(df.limit(0), PATH).count() == 0


def test_prefix_products():
    r = np.random.default_rng(1)
    stack = r.integers(-50, 0, (11, 4, 4))
    want, now = [], None
    for m in stack:
        now = m if now is None else (now[:, :, None] + m[None]).max(1)
        want.append(now)
    assert np.array_equal(P.prefix_products(stack), want)


def test_workers_keep_no_vocabulary_for_other_operators(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(8)

    def loaded(keeps):
        def run(batches):
            for batch in slices(batches, 1000, keeps):
                yield pa.RecordBatch.from_arrays([pa.array([len(P._LOADED)])], names=["n"])

        return sum(r.n for r in spark.range(0, 800, 1, 8).mapInArrow(run, "n long").collect())

    P.encode_texts(df, PATH).write.format("noop").mode("overwrite").save()
    assert loaded("pieces") > 0
    assert loaded(None) == 0
