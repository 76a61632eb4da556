"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"  # a word, as the contracts define it


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs on one
    machine (tests) a temporary folder is made, once per application.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and the rows
    stay the same however often they are read and whichever executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = out, path
    return out


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these tables, once nothing that is still to run reads
    them: all that was made of them has been written itself."""
    for df in tables:
        _, path = _WRITTEN.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def guarded(operator: Callable) -> Callable:
    """For an operator on a DataFrame, its first argument: columns of the input that start with two
    underscores, as the operator's own do, are set aside under other names while it runs. They come
    back under their names, unless the operator returns a column of that name, which replaces them.
    String arguments that name such a column follow."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        own = [c for c in df.columns if c.startswith("__")]
        if not own:
            return operator(df, *args, **kwargs)
        free = (f"aside{i}" for i in range(len(own) + len(df.columns)))
        taken = {c.lower() for c in df.columns}
        to = dict(zip(own, (x for x in free if x not in taken)))

        def renamed(x):
            if isinstance(x, str):
                return to.get(x, x)
            return [renamed(y) for y in x] if isinstance(x, list) else x

        out = operator(df.withColumnsRenamed(to), *map(renamed, args), **{k: renamed(v) for k, v in kwargs.items()})
        made = {c.lower() for c in out.columns}
        out = out.drop(*(v for k, v in to.items() if k.lower() in made))
        return out.withColumnsRenamed({v: k for k, v in to.items() if k.lower() not in made})

    return run


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


_KEPT: dict[str, Callable[[], None]] = {}  # in a Python worker: by operator what drops the tables it keeps there


def give_back() -> None:
    """Memory that this Python worker has free goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batches, rows: int, keeps: str | None = None):
    """Arrow batches in parts of ``rows`` rows, so that little stands in memory as Python objects.

    Spark uses idle workers by turns, for one operator after another. So a task first drops what other
    operators than ``keeps`` hold in its worker (``_KEPT``), and gives back in the end what it has freed."""
    others = [x for x in _KEPT if x != keeps]
    for x in others:
        _KEPT.pop(x)()
    if others:
        gc.collect()
        give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


def text_key(text: str = "text") -> Column:
    """128 bits of a text's UTF-8 bytes, as a binary: texts are told apart by it."""
    return F.unhex(F.md5(text_bytes(text)))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none of its own."""
    twice = edges.groupBy("a").count().filter("count > 1").select("a")
    inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return twice.union(inner).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type to ``(node, root)``: root is the smallest node
    that is reachable. Only nodes with an edge are returned.

    Alternates large-star and small-star steps, each a min-aggregation and a join, until every
    edge points to a root. The least neighbours are written before they are joined, and so is every
    round: between two tables Spark splits or broadcasts the join of a node with very many edges.
    """
    now = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    while not _settled(now):
        old = now
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "cc-low")
        large = materialize(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large"
        )
        # every edge now points from the larger node to a smaller one
        release(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct(), "cc")
        release(old, large, low)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
