import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.sharding import shard_by_bytes, write_shards


def brute(rows, n):
    total, at, out, slots = sum(s for _, s in rows), 0, [], {}
    for i, s in sorted(rows):
        shard = min(n - 1, int((at + s / 2) * n / total))
        out.append((i, s, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += s
    return out


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.choice([16, 40, 900, 20000])) for i in range(3000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, size long")
    got = shard_by_bytes(df, 40, "size", ["doc_id"])
    assert sorted(map(tuple, got.collect())) == brute(rows, 40)


def test_hot_key_nulls_and_names(spark):
    rows = [(7, None, "x", 1)] * 500 + [(None, 10, "y", 2)] * 20 + [(i, 10, None, 3) for i in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard string, __n int")
    got = shard_by_bytes(df, 5, "size", ["doc_id"]).collect()
    assert len(got) == len(rows)
    for s in range(5):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    sums = [sum(x["size"] or 0 for x in got if x.shard == s) for s in range(5)]
    assert max(sums) - min(sums) <= 20
    assert shard_by_bytes(df.limit(0), 5, "size", ["doc_id"]).count() == 0


def test_written_shards_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, 10, "t" * i) for i in range(50)], "doc_id long, size long, text string")
    write_shards(shard_by_bytes(df, 4, "size", ["doc_id"]), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select(F.countDistinct("shard")).first()[0] == 4
