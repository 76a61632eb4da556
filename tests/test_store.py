import os
import threading

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.sources import store as S

WORDS = "river stone meadow harbour lantern bridge".split()


def chunks(spark, a, b, mark=""):
    rows = [(f"d{i // 3}", f"c{i:03d}", " ".join(WORDS[(i * k + k) % 6] for k in range(1, 4 + i % 5)) + f" n{i % 7} {mark}", [1.0, float(i)]) for i in range(a, b)]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, vector array<double>").repartition(3)


def same_index(made, rows):
    want = retrieval.index(rows)
    for a, b in zip(made, want):
        key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect())
        assert key(a) == key(b)


def content(df):
    return sorted((r.chunk_id, r.text) for r in df.collect())


def test_two_appends_equal_one_index(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/s", dim=2)
    assert s.latest() == 0 and s.chunks().count() == 0 and s.index()[2].first().n == 0
    assert (s.append(chunks(spark, 0, 20)), s.append(chunks(spark, 20, 50))) == (1, 2)
    same_index(s.index(), chunks(spark, 0, 50))
    same_index(s.index(1), chunks(spark, 0, 20))  # a version stays as it is
    asked = spark.createDataFrame([(1, 0, "river n3"), (2, 0, "bridge")], "qid long, query_idx int, text string")
    hits = lambda made: sorted(map(tuple, retrieval.bm25(asked, s.chunks(), 5, made).select("qid", "chunk_id", "score", "rank").collect()))
    assert hits(s.index()) == hits(None)


def test_changes_replace_and_remove(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/s")
    s.append(chunks(spark, 0, 30))
    s.put(chunks(spark, 10, 15, "again"), chunks(spark, 0, 3))
    s.remove(chunks(spark, 28, 60))
    s.append(chunks(spark, 28, 29, "back"))
    live = chunks(spark, 3, 10).union(chunks(spark, 10, 15, "again")).union(chunks(spark, 15, 28)).union(chunks(spark, 28, 29, "back"))
    assert content(s.chunks()) == content(live)
    same_index(s.index(), live)
    assert content(s.chunks(1)) == content(chunks(spark, 0, 30))
    version = s.compact()
    assert version == 5 and len(s.manifest()["parts"]) == 1
    assert content(s.chunks()) == content(live) and content(s.chunks(1)) == content(chunks(spark, 0, 30))
    same_index(s.index(), live)
    assert s.vacuum() == 4 and s.versions() == [5] and content(s.chunks()) == content(live)
    s.append(chunks(spark, 40, 41))
    assert s.latest() == 6 and s.chunks().count() == 27


def test_a_failed_change_leaves_nothing(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/s", dim=2)
    s.append(chunks(spark, 0, 5))
    before = sorted(os.listdir(f"{tmp_path}/s/parts"))
    bad = [chunks(spark, 5, 9).withColumn("vector", F.array(F.lit(1.0))), chunks(spark, 5, 7).union(chunks(spark, 6, 8)), chunks(spark, 5, 6).withColumn("chunk_id", F.lit(None).cast("string"))]
    bad.append(chunks(spark, 5, 9).withColumn("text", F.when(F.col("chunk_id") == "c008", F.raise_error(F.lit("broken"))).otherwise(F.col("text"))))
    for rows in bad:
        with pytest.raises(Exception):
            s.append(rows)
    assert s.latest() == 1 and sorted(os.listdir(f"{tmp_path}/s/parts")) == before and s.chunks().count() == 5


def test_tokens_and_conflicts(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/s")
    assert [s.append(chunks(spark, 0, 4), token="batch 1") for _ in range(2)] == [1, 1] and s.chunks().count() == 4
    assert s._create(2, s.manifest()) and not s._create(2, {"parts": [], "tokens": []}) and len(s.manifest(2)["parts"]) == 1
    with pytest.raises(S.Conflict):
        s._commit(lambda m: m, follows=1)
    done = []
    many = [threading.Thread(target=lambda i=i: done.append(s.append(chunks(spark, 10 * i, 10 * i + 2)))) for i in range(1, 4)]
    [t.start() for t in many]
    [t.join() for t in many]
    assert sorted(done) == [3, 4, 5] and s.chunks().count() == 10


def test_a_claim_that_was_lost_does_not_block(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/s")
    s.append(chunks(spark, 0, 2))
    (tmp_path / "s/versions/.000000000002").touch()  # claimed, but the manifest never came
    with pytest.raises(S.Conflict):
        s.append(chunks(spark, 2, 4))
    os.utime(tmp_path / "s/versions/.000000000002", (1, 1))
    assert s.append(chunks(spark, 2, 4)) == 2 and s.chunks().count() == 4


def test_sync_equals_a_rebuild_and_parses_changes_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.txt").write_text(f"river {i} stone\n\nmeadow {i}")
    seen = []

    def to_chunks(files):
        seen.append(sorted(r.path.rpartition("/")[2] for r in files.select("path").collect()))
        rows = files.select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\n\n")).alias("n", "text"))
        return rows.select("doc_id", F.concat_ws(":", "doc_id", "n").alias("chunk_id"), "text")

    s = S.Store(spark, f"file://{tmp_path}/s")
    assert S.sync(s, str(folder), to_chunks) == {"new": 6, "changed": 0, "gone": 0, "same": 0}
    assert S.sync(s, str(folder), to_chunks) == {"new": 0, "changed": 0, "gone": 0, "same": 6} and s.latest() == 1
    (folder / "f1.txt").write_text("one paragraph now")
    (folder / "f2.txt").unlink()
    (folder / "f3.txt").write_text("river 3 stone\n\nmeadow 3")  # written again, the same
    os.utime(folder / "f3.txt", (1, 1))
    (folder / "g.txt").write_text("a new file")
    (folder / "skip.xyz").write_text("no format")
    assert S.sync(s, str(folder), to_chunks) == {"new": 1, "changed": 1, "gone": 1, "same": 4}
    assert seen[1:] == [["f1.txt", "g.txt"]]
    fresh = S.Store(spark, f"file://{tmp_path}/fresh")
    S.sync(fresh, str(folder), to_chunks)
    assert content(s.chunks()) == content(fresh.chunks()) and s.chunks().count() == 10
    same_index(s.index(), fresh.chunks())
    s.compact()
    assert S.sync(s, str(folder), to_chunks) == {"new": 0, "changed": 0, "gone": 0, "same": 6}
