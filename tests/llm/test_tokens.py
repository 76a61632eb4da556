import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import tokens as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=80)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=9000), st.integers(1, 3))
def test_pack_round_trip(ids, times):
    ids = np.array(ids * times, np.uint64)
    words, offsets, escapes = T.pack(ids)
    assert np.array_equal(T.unpack(words, offsets, escapes, len(ids)), ids)
    data = T.segment([5, None], [len(ids), 0], ids, 17)
    docs, lengths, back, before = T.read_segment(data)
    assert (docs, lengths.tolist(), before) == ([5, None], [len(ids), 0], 17) and np.array_equal(back, ids)


def test_most_ids_go_into_each_word():
    ids = np.array([1] * 60 + [60000] * 3 + [2**60] + [0] * 7, np.uint64)
    words, offsets, escapes = T.pack(ids)
    assert len(words) == 1 + 1 + 2 + 1 and escapes.tolist() == [2]


TEXTS = [None, "", "  ", "It's a Test.\nOf   42 things here!", "<|endoftext|> and<|startoftext|>x", "é é ́x ΑΣ ΟΔΟΣ.", "a\x1cb\x85c d\te\r\nf", "🙂 日本語 ###", "don't won'T 'tis", "x" * 3000]
TEXTS += ["It is, so. It ends..", "a,b.c", "a.,b", "Über, ß. ÿ×÷", "1,5 .", "x.\ny,"]
TEXTS += ["".join(map(chr, range(a, a + 16))) + " a" + chr(a) + "'S" + chr(a + 3) + "B9" for a in range(0, 0x3000, 16)]


def test_ids_equal_the_library():
    lib = Tokenizer.from_file(PATH)
    want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in T.encode_texts(TEXTS, PATH)]
    assert got == want


def test_files_are_in_order_and_read_back(spark, tmp_path, monkeypatch):
    rows = [(i * 37 % 101, TEXTS[i % 10]) for i in range(100)] + [(None, "null id"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    T.write_ids(df, str(tmp_path / "ids"), PATH)
    got = sorted(map(tuple, T.read_ids(spark, str(tmp_path / "ids")).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == sorted((x[0] for x in rows), key=lambda x: -1 if x is None else x)
    at, lib = 0, Tokenizer.from_file(PATH)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    for key, start, n, data in got:
        assert start == at and n * 4 == len(data)
        assert list(struct.unpack(f"<{n}I", bytes(data))) in want[key]
        at += n
    T.write_ids(df.limit(0), str(tmp_path / "none"), PATH)
    assert T.read_ids(spark, str(tmp_path / "none")).count() == 0
    sums = {r.start: r.ids_crc32 for r in T.read_ids(spark, str(tmp_path / "ids"), digest=True).collect()}
    assert sums == {x[1]: zlib.crc32(bytes(x[3])) for x in got}
