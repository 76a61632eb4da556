"""Each query with SQL gives the rows that DuckDB gives; the others keep their invariants."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = Counter(tuple(same(r[c]) for c in columns) for r in got.collect())
    rows = want.fetchall()
    place = [want.columns.index(c) for c in columns]
    theirs = Counter(tuple(same(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in place) for r in rows)
    assert mine == theirs and len(rows) > 0


@pytest.mark.parametrize("name", ["recursive_chunks", "structural_chunks", "procedure_chunks", "parent_child_chunks"])
def test_chunks_are_numbered_and_stripped(spark, name):
    rows = entry.queries()[name](spark, DATA).collect()
    by = {}
    for r in rows:
        assert r.text and r.text == r.text.strip()
        by.setdefault(r.doc_id, []).append(r.position)
    # documents of one line are a heading without a section here
    assert len(by) == (174 if name == "structural_chunks" else 200) and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 40


def test_same_rows_under_other_partitions(spark, tmp_path):
    d = str(tmp_path)
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{n}.parquet").repartition(7).write.parquet(f"{d}/{n}.parquet")
    for name in ("bm25_topk", "parent_child_chunks"):
        a, b = (sorted(map(tuple, entry.queries()[name](spark, x).collect()), key=repr) for x in (DATA, d))
        assert a == b
