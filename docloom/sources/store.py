"""A store of chunks, vectors and postings with versions.

A part is a folder of Parquet tables: chunks, their postings, the parts' own counts by term and in sum, the ids that it
removes from earlier parts, and the files that the chunks came from. A version is a small manifest that lists parts in order. A
change writes its part first and then the manifest of the next version, which is created only if no one else has: so
readers see all of a change or nothing, a version stays as it is, and a failed change leaves nothing behind.

What several parts say is merged when it is read: live chunks are those that no later part removes; counts by
term are sums over parts, and are counted from the postings only where something was removed. ``compact`` puts all
parts into one; ``vacuum`` deletes parts that only old versions list.

Defined cases: an empty change makes a version with an empty part; of a chunk that is put again the last one counts;
removing what is not there changes nothing; a change under a token that the store has seen is not made again; vectors of
another length than the store's are an error, and so is a null or repeated chunk_id within a change.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.retrieval import EPSILON, small
from ..operators.written import written
from . import files as sources

TRIES = 20  # of a commit, while others commit too
STALE = 600  # seconds after which a claim on a version that never appeared is void


class Conflict(Exception):
    """Another change was made since, and this one can't follow it."""


class Store:
    """``path``: a folder that the driver and all executors see. ``dim``: the length of vectors, if chunks have any."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self._jvm = spark._jvm

    # --- manifests ------------------------------------------------------------------------

    def _place(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _delete(self, path: str) -> None:
        fs, place = self._place(path)
        fs.delete(place, True)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def versions(self) -> list[int]:
        fs, place = self._place(f"{self.path}/versions")
        if not fs.exists(place):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(place))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """0 for a store that has no version yet."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"parts": [], "tokens": []}
        fs, place = self._place(self._manifest(version))
        stream = fs.open(place)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, content: dict) -> bool:
        """Writes a manifest under another name and renames it, unless the version exists."""
        fs, place = self._place(self._manifest(version))
        _, draft = self._place(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        # the marker is created by one only; the manifest is complete when it appears
        _, marker = self._place(f"{self.path}/versions/.{version:012d}")
        try:
            fs.create(marker, False).close()
        except Exception:  # noqa: BLE001  it exists: another has this version, or was lost while it made it
            fs.delete(draft, False)
            if not fs.exists(place) and fs.exists(marker) and time.time() - fs.getFileStatus(marker).getModificationTime() / 1000 > STALE:
                fs.delete(marker, False)
            return False
        return bool(fs.rename(draft, place))

    def _commit(self, change: Callable[[dict], dict], follows: int | None = None) -> int:
        for _ in range(TRIES):
            last = self.latest()
            if follows is not None and last != follows:
                raise Conflict(f"version {last} was made after {follows}")
            if self._create(last + 1, change(self.manifest(last))):
                return last + 1
        raise Conflict("others commit all the time")

    # --- changes --------------------------------------------------------------------------

    def _part(self, chunks: DataFrame | None, removed: DataFrame | None, origins: DataFrame | None) -> dict:
        """Writes a part and tells what it holds; leaves nothing if that fails."""
        name = uuid.uuid4().hex
        folder, part = f"{self.path}/parts/{name}", {"name": name, "n": 0, "words": 0, "removes": False}
        try:
            if removed is not None:
                removed.select("chunk_id").distinct().write.parquet(f"{folder}/removed")
                part["removes"] = not self.spark.read.parquet(f"{folder}/removed").isEmpty()
            if origins is not None:
                origins.write.parquet(f"{folder}/origins")
            if chunks is not None:
                if self.dim is not None:
                    right = F.assert_true(F.size("vector") == self.dim, F.lit(f"vectors must have {self.dim} components"))
                    chunks = chunks.filter(right.isNull())
                chunks.write.parquet(f"{folder}/chunks")
                own = self.spark.read.parquet(f"{folder}/chunks")
                if not own.groupBy("chunk_id").count().filter("chunk_id is null or count > 1").isEmpty():
                    raise ValueError("chunk_id must be there and must not repeat")
                retrieval.postings(own).write.parquet(f"{folder}/postings")
                post = self.spark.read.parquet(f"{folder}/postings")
                post.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")
                part |= {"n": own.count(), "words": post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("w")).first().w, "chunks": own.columns}
        except BaseException:
            self._delete(folder)
            raise
        return part

    def _made(self, part: dict, token: str | None, follows: int | None = None, instead: bool = False) -> int:
        def change(old: dict) -> dict:
            if token is not None and token in old["tokens"]:
                raise _Seen
            return {"parts": [part] if instead else [*old["parts"], part], "tokens": old["tokens"] + ([token] if token is not None else [])}

        try:
            return self._commit(change, follows)
        except _Seen:
            self._delete(f"{self.path}/parts/{part['name']}")
            return self.latest()
        except BaseException:
            self._delete(f"{self.path}/parts/{part['name']}")
            raise

    def _seen(self, token: str | None) -> bool:
        return token is not None and token in self.manifest()["tokens"]

    def append(self, chunks: DataFrame, token: str | None = None) -> int:
        """Adds ``chunks(chunk_id, text[, vector], ...)``, none of which the store has; returns the new version. ``token``
        names the change, so that it is made once however often it is tried."""
        return self.latest() if self._seen(token) else self._made(self._part(chunks, None, None), token)

    def put(self, chunks: DataFrame, removed: DataFrame | None = None, origins: DataFrame | None = None, token: str | None = None) -> int:
        """Adds chunks in place of those of the same ids, and removes those of ``removed(chunk_id)``, in one version."""
        if self._seen(token):
            return self.latest()
        gone = chunks.select("chunk_id") if removed is None else chunks.select("chunk_id").unionByName(removed.select("chunk_id"))
        return self._made(self._part(chunks, gone, origins), token)

    def remove(self, removed: DataFrame, token: str | None = None) -> int:
        return self.latest() if self._seen(token) else self._made(self._part(None, removed, None), token)

    def compact(self) -> int:
        """A version of one part that holds what is live. Fails with ``Conflict`` if the store changes meanwhile."""
        last = self.latest()
        origins = self.origins(last)
        return self._made(self._part(self.chunks(last), None, origins), None, follows=last, instead=True)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions, and parts that no version lists. Returns how many parts went.
        Not to be run while changes are being made."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        used = {p["name"] for v in kept for p in self.manifest(v)["parts"]}
        for v in old:
            self._delete(self._manifest(v))
        fs, place = self._place(f"{self.path}/parts")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        gone = [n for n in names if n not in used]
        for n in gone:
            self._delete(f"{self.path}/parts/{n}")
        return len(gone)

    # --- reading --------------------------------------------------------------------------

    def _read(self, parts: list[dict], table: str, has: Callable[[dict], bool]) -> DataFrame | None:
        """A table of several parts, with the number of each row's part (``part``)."""
        out = None
        for i, p in enumerate(parts):
            if has(p):
                one = self.spark.read.parquet(f"{self.path}/parts/{p['name']}/{table}").withColumn("part", F.lit(i))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def _live(self, parts: list[dict], rows: DataFrame) -> DataFrame:
        """Without the rows of chunks that a later part removes."""
        gone = self._read(parts, "removed", lambda p: p["removes"])
        if gone is None:
            return rows.drop("part")
        last = written(gone.groupBy("chunk_id").agg(F.max("part").alias("gone")), "store-removed")
        return rows.join(small(last), "chunk_id", "left").filter("gone is null or gone <= part").drop("part", "gone")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The live chunks of a version, the last if none is named."""
        parts = self.manifest(version)["parts"]
        rows = self._read(parts, "chunks", lambda p: "chunks" in p)
        if rows is None:
            return self.spark.createDataFrame([], "chunk_id string, text string")
        return self._live(parts, rows)

    def index(self, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, terms, totals) of a version, as ``retrieval.index`` makes them of its chunks: pass it to searches as
        ``made``. No text is read for it."""
        parts = self.manifest(version)["parts"]
        has = lambda p: "chunks" in p
        post = self._read(parts, "postings", has)
        if post is None:
            return retrieval.index(self.spark.createDataFrame([], "chunk_id string, text string"))
        post = self._live(parts, post)
        if any(p["removes"] for p in parts):
            post = written(post, "store-postings")
            n = self._live(parts, self._read(parts, "chunks", has).select("chunk_id", "part")).count()
            words = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("w")).first().w
            df = post.groupBy("term").agg(F.count("*").alias("df"))
        else:
            n, words = (sum(p[k] for p in parts) for k in ("n", "words"))
            df = self._read(parts, "terms", has).groupBy("term").agg(F.sum("df").alias("df"))
        totals = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(words).cast("long").alias("words"))
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = written(df.withColumn("raw", raw), "store-terms")
        mean = terms.agg(F.avg("raw").alias("mean"))
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
        return post, terms.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), totals

    def origins(self, version: int | None = None) -> DataFrame:
        """``(path, doc_id, mark, hash)`` of the files that the live chunks came from, as ``sync`` keeps them."""
        parts = self.manifest(version)["parts"]
        found = None
        for p in reversed(parts):  # the last part that has them has all
            fs, place = self._place(f"{self.path}/parts/{p['name']}/origins")
            if fs.exists(place):
                found = self.spark.read.parquet(place.toString())
                break
        return self.spark.createDataFrame([], "path string, doc_id string, mark string, hash string") if found is None else found


class _Seen(Exception):
    """The change was made before."""


def sync(store: Store, folder: str, to_chunks: Callable[[DataFrame], DataFrame], recursive: bool = True) -> dict[str, int]:
    """Brings a store up to date with a folder of files and tells how many are ``new``, ``changed``, ``gone`` and ``same``.

    Files whose length and time of change are known are not opened; of the others the content's hash decides. Only
    new and changed files go to ``to_chunks(files(doc_id, path, format, content))``, which returns ``(doc_id, chunk_id, text, ...)``;
    their old chunks and those of files that are gone are removed in the same version. A run in which nothing changed makes
    no version.
    """
    spark = store.spark
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    mark = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    found = written(listed.select("path", mark.alias("mark")).join(sources.scan(spark, folder, recursive).select("path", "doc_id"), "path"), "sync-listed")
    known = written(store.origins(), "sync-known")
    touched = written(found.join(known.select("path", "mark"), ["path", "mark"], "left_anti"), "sync-touched")
    content = sources.scan(spark, folder, recursive).join(small(touched.select("path", "mark")), "path").withColumn("hash", F.sha2("content", 256))
    old = known.select("path", F.col("hash").alias("old"))
    opened = written(content.select("path", "doc_id", "mark", "hash").join(old, "path", "left"), "sync-opened")
    work = opened.filter("old is null or old <> hash")
    gone = known.join(found.select("path"), "path", "left_anti")
    counts = {"new": opened.filter("old is null").count(), "changed": opened.filter("old <> hash").count(), "gone": gone.count()}
    counts["same"] = found.count() - counts["new"] - counts["changed"]
    if touched.isEmpty() and not counts["gone"]:
        return counts
    some = sources.scan(spark, folder, recursive).join(small(work.select("path")), "path", "left_semi")
    chunks = written(to_chunks(some), "sync-chunks")
    live = store.chunks()
    stale = opened.filter("old <> hash").select("doc_id").unionByName(gone.select("doc_id"))
    removed = live.join(small(stale), "doc_id", "left_semi").select("chunk_id") if "doc_id" in live.columns else live.select("chunk_id").limit(0)
    stay = known.join(found.select("path"), "path", "left_semi").join(touched.select("path"), "path", "left_anti")
    origins = stay.select("path", "doc_id", "mark", "hash").unionByName(opened.select("path", "doc_id", "mark", "hash"))
    store.put(chunks, removed, origins)
    return counts
