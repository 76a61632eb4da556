"""Exact top-k by cosine for any number of queries and vectors.

Vectors are stored in blocks: each belongs to the nearest of some pivots (those with the smallest hash of
their id) and keeps its angle to it; neighbours in (pivot, angle) share a block. By the triangle inequality the
angle between a query and a block's vectors is at least the gap between the query's angle to the pivot and
the block's range of angles, so the cosine is at most that of the gap.

1. Each block of queries meets its nearest blocks, which gives each query a score that its k-th hit reaches.
2. Of all other tiles only those that can reach it are run; within a tile, only the queries that can.

Queries that fit one block are sent to the vectors instead, which then don't move at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .written import written

PLACES = 6
PIVOTS = 64
ROWS = 1000  # texts whose vectors are made at once
SEEDS = 4  # tiles of a block of queries that are run first
SLACK = 1e-6  # of angles and cosines, for their rounding
ZERO, NONE = -1, -2  # pivots of zero vectors, and of those without a pivot of their length


def usable(column: str) -> Column:
    """Vectors with a component, none of which is null or not finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(column) > 0) & F.forall(column, good), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is scaled by a power of two first, so that no square overflows."""
    top = np.abs(x).max(1, initial=0)
    x = np.ldexp(x, -np.frexp(top)[1][:, None])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def pivots_of(rows: DataFrame, id_col: str, vector_col: str, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """By length, the vectors with the smallest hashes of their ids, ``count`` of them in all."""
    some = rows.select(F.col(vector_col).alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(count).collect()
    out: dict[int, list] = {}
    for r in some:
        if any(r.v):
            out.setdefault(len(r.v), []).append(r.v)
    return {n: _unit(np.array(v, float)) for n, v in out.items()}


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], all_angles: bool) -> DataFrame:
    """``rows(..., vector)`` plus ``size``, ``pivot`` and ``angle``; with ``all_angles`` those to every pivot."""
    at = rows.columns.index("vector")
    extra = {"size": F.lit(0), "pivot": F.lit(0), "angle": F.lit(0.0)} | ({"angles": F.lit(None).cast("array<double>")} if all_angles else {})
    schema = rows.withColumns(extra).schema

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            sizes = np.diff(column.offsets.to_numpy())
            pivot, angle = np.full(len(sizes), NONE, np.int32), np.zeros(len(sizes))
            every: list = [None] * len(sizes)
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                x = tiles.matrix(column.take(pa.array(of)))
                zero = ~x.any(1)
                pivot[of[zero]] = ZERO
                if size in pivots:
                    far = _angles(_unit(x), pivots[size])
                    near = far.argmin(1)
                    pivot[of[~zero]] = near[~zero]
                    angle[of] = far[np.arange(len(of)), near]
                    for i, k in enumerate(of.tolist()):
                        every[k] = None if zero[i] else far[i]
            out = [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(pivot), pa.array(angle)]
            if all_angles:
                out.append(pa.array(every, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)


def index(chunks: DataFrame, where: str | None = None, block_rows: int = tiles.BLOCK_ROWS, count: int = PIVOTS) -> tuple[DataFrame, DataFrame, dict]:
    """``chunks(chunk_id, vector)`` as (vectors in blocks, a row for each block, pivots), written once: pass it to
    several searches. A block's row holds its length of vectors, its value of ``where``, pivot and range of angles."""
    group = F.col(where) if where else F.lit(0)
    rows = chunks.filter(usable("vector") & F.col("chunk_id").isNotNull() & group.isNotNull()).select("chunk_id", "vector", group.alias("of"))
    pivots = pivots_of(rows, "chunk_id", "vector", count)
    placed = tiles.numbered(_placed(rows, pivots, False), ["size", "of", "pivot"], ["angle", "chunk_id"], "vector", block_rows)
    vectors = written(placed.withColumnRenamed("block", "right_block"), "vector-blocks")
    blocks = vectors.groupBy("right_block", "size", "of", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    return vectors, written(blocks, "vector-ranges"), pivots


def _query_blocks(queries: DataFrame, where: str | None, pivots: dict, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries in blocks of neighbours, and by block and pivot their range of angles."""
    group = F.col(where) if where else F.lit(0)
    rows = queries.filter(usable("vector") & group.isNotNull()).select("query", "vector", group.alias("of"))
    rows = rows.withColumn("qid", F.monotonically_increasing_id())
    placed = _placed(rows, pivots, True).withColumn("blind", F.col("angles").isNull())
    placed = tiles.numbered(placed, ["size", "of", "blind"], ["angle", "qid"], "vector", block_rows, loose=["pivot"])
    asked = written(placed.withColumnRenamed("block", "left_block"), "query-blocks")
    # a query without angles can be near anything
    each = asked.select("left_block", "size", "of", F.posexplode(F.coalesce("angles", F.array(F.lit(None).cast("double")))).alias("pivot", "a"))
    ranges = each.groupBy("left_block", "size", "of", "pivot").agg(F.min("a").alias("from"), F.max("a").alias("to"), F.bool_or(F.col("a").isNull()).alias("any"))
    whole = asked.groupBy("left_block", "size", "of").agg(F.bool_or(F.col("angles").isNull()).alias("unknown"))
    return asked, written(ranges.join(whole, ["left_block", "size", "of"]), "query-ranges")


def pairs(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(left_block, right_block, gap)`` of blocks of one length and group: no query of the one is nearer than
    ``gap`` (an angle) to a vector of the other."""
    gap = F.greatest(F.lit(0.0), F.col("from") - F.col("high"), F.col("low") - F.col("to"))
    near = ranges.filter("from is not null").join(blocks.filter("pivot >= 0"), ["size", "of", "pivot"])
    near = near.select("left_block", "right_block", "n", F.when(F.col("unknown"), 0.0).otherwise(gap).alias("gap"))
    # zero vectors are at a right angle to all; without a pivot nothing is known. Nor is it of zero queries.
    lefts = ranges.groupBy("left_block", "size", "of").agg(F.bool_or("unknown").alias("unknown"), F.bool_and(F.col("from").isNull()).alias("blind"))
    odd = lefts.join(blocks, ["size", "of"]).filter("pivot < 0 or blind")
    right = F.when((F.col("pivot") == ZERO) & ~F.col("unknown"), np.pi / 2).otherwise(0.0)
    return near.unionByName(odd.select("left_block", "right_block", "n", right.alias("gap")))


def _run_tiles(asked: DataFrame, vectors: DataFrame, chosen: DataFrame, top_k: int, kinds: tuple[str, str]) -> DataFrame:
    """Hits of ``chosen(left_block, right_block)`` tiles. ``asked`` may hold ``least``, what a hit must reach."""
    spark = asked.sparkSession
    n = tiles.groups(spark, chosen.select("left_block").distinct().count())
    dealt = chosen.select("left_block", "right_block", F.pmod(F.xxhash64("right_block"), F.lit(n)).cast("int").alias("tile_group"))
    left = asked.join(dealt.select("left_block", "tile_group").distinct(), "left_block")
    right = vectors.join(dealt, "right_block").select("left_block", "tile_group", "right_block", "chunk_id", "vector", "pivot", "angle")
    columns = ["left_block", "tile_group", "qid", "query", "vector", "angles", "least"]

    def run(batches):
        key, queries, best = None, [], None

        def done():
            if best is None:
                return
            row, name, score = best.found()
            if len(row):
                names = pa.array(name.tolist(), kind)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), own.take(pa.array(row)), names, pa.array(score)], names=["qid", "query", "chunk_id", "score"])

        for (block, group, side), batch in tiles.runs(batches, "right_block"):
            if (block, group) != key:
                yield from done()
                key, queries, best = (block, group), [], None
            if side == 0:
                queries.append(batch)
                continue
            kind = batch.column("chunk_id").type
            if best is None:
                ids, own, v, known, floor = (pa.concat_arrays([q.column(c) for q in queries]) for c in ("qid", "query", "vector", "angles", "least"))
                x, least = _unit(tiles.matrix(v)), floor.fill_null(-np.inf).to_numpy(zero_copy_only=False)
                blind = known.is_null().to_numpy(zero_copy_only=False)
                # those without angles stand at 0 with no limit
                wide = max(map(len, (a for a in known.to_pylist() if a)), default=0)
                far = np.array([a or [0.0] * wide for a in known.to_pylist()]).reshape(len(ids), wide)
                best = tiles.Best(len(ids), top_k)
                best.least = np.maximum(best.least, least)
            names = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            rows = np.arange(len(ids))
            p = batch.column("pivot")[0].as_py()
            if p >= 0 and wide:
                angle = batch.column("angle").to_numpy()
                gap = np.maximum(np.maximum(far[:, p] - angle.max(), angle.min() - far[:, p]) - SLACK, 0)
                rows = np.flatnonzero(blind | (np.cos(np.minimum(gap, np.pi)) + SLACK >= best.least))
            if len(rows):
                y = _unit(tiles.matrix(batch.column("vector").take(pa.array(order))))
                best.offer(np.round(x[rows] @ y.T, PLACES), names[order], rows)
        yield from done()

    schema = f"qid long, query {kinds[0]}, chunk_id {kinds[1]}, score double"
    return tiles.stream(left.select(*columns), right, run, schema, "right_block")


def _by_broadcast(block: list, chunks: DataFrame, top_k: int, where: str | None, kinds: tuple[str, str]) -> DataFrame:
    """Hits of a block of queries, each task's best: the queries go to the vectors."""
    groups: dict = {}
    for i, r in enumerate(block):
        groups.setdefault((len(r.vector), r["of"]), []).append(i)
    of = {k: (np.array(v), _unit(np.array([block[i].vector for i in v], float))) for k, v in groups.items()}
    names = pa.array([r["query"] for r in block])
    group = F.col(where) if where else F.lit(0)

    def run(batches):
        best: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, tiles.BLOCK_ROWS):
                some = batch.slice(at, tiles.BLOCK_ROWS)
                sizes = np.diff(some.column(1).offsets.to_numpy())
                keys = np.array(some.column(2).to_pylist(), object)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                for key, (rows, x) in of.items():
                    mine = order[(sizes[order] == key[0]) & (keys[order] == key[1])]
                    if len(mine):
                        y = _unit(tiles.matrix(some.column(1).take(pa.array(mine))))
                        best.setdefault(key, tiles.Best(len(rows), top_k)).offer(np.round(x @ y.T, PLACES), ids[mine])
        for key, b in best.items():
            row, name, score = b.found()
            own = of[key][0][row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), names.take(pa.array(own)), pa.array(name.tolist()), pa.array(score)], names=["qid", "query", "chunk_id", "score"]
            )

    rows = chunks.filter(usable("vector") & F.col("chunk_id").isNotNull() & group.isNotNull()).select("chunk_id", "vector", group.alias("of"))
    return rows.mapInArrow(run, f"qid long, query {kinds[0]}, chunk_id {kinds[1]}, score double")


def _ranked(hits: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def topk_tiles(
    queries: DataFrame, chunks: DataFrame, top_k: int, where: str | None = None, made: tuple | None = None, block_rows: int = tiles.BLOCK_ROWS, pivots: int = PIVOTS
) -> tuple[DataFrame, dict[str, int]]:
    """(hits, numbers of tiles: ``all``, ``seeds`` and ``run``) of ``queries(query, vector)``."""
    vectors, blocks, points = made or index(chunks, where, block_rows, pivots)
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    asked, ranges = _query_blocks(queries, where, points, block_rows)
    all_ = written(pairs(ranges, blocks), "tiles")
    near = Window.partitionBy("left_block").orderBy("gap", F.desc("n"), "right_block")
    first = written(all_.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= SEEDS).drop("nth"), "tiles-first")
    none = F.lit(None).cast("double").alias("least")
    seeds = written(_ranked(_run_tiles(asked.withColumn("least", none), vectors, first, top_k, kinds), top_k), "hits-first")
    reached = seeds.groupBy("qid").agg(F.count("*").alias("k"), F.min("score").alias("least")).filter(F.col("k") >= top_k).drop("k")
    asked = written(asked.join(reached, "qid", "left"), "query-reached")
    low = asked.groupBy("left_block").agg(F.min(F.coalesce("least", F.lit(-2.0))).alias("low"))
    later = all_.join(first.select("left_block", "right_block"), ["left_block", "right_block"], "left_anti").join(low, "left_block")
    can = F.cos(F.greatest(F.col("gap") - SLACK, F.lit(0.0))) + SLACK >= F.col("low")
    later = written(later.filter(can), "tiles-later")
    hits = seeds.drop("rank").unionByName(_run_tiles(asked, vectors, later, top_k, kinds))
    counts = {"all": all_.count(), "seeds": first.count()}
    counts["run"] = counts["seeds"] + later.count()
    return _ranked(hits, top_k).drop("qid"), counts


def cosine_topk(
    queries: DataFrame, chunks: DataFrame, top_k: int, where: str | None = None, max_queries: int = tiles.BLOCK_ROWS, made: tuple | None = None
) -> DataFrame:
    """``queries(query, vector)`` against ``chunks(chunk_id, vector)``: exact top-k by cosine, ``(query, chunk_id, score,
    rank)``. With ``where``, a column of both, only chunks that agree in it are ranked at all. ``made``: the
    chunks' ``index``, if there is one; else it is made where there are more than ``max_queries``, a block of queries.

    Vectors of different lengths never meet; null vectors, empty ones, ones with a component that is null or not
    finite, and rows whose ``where`` or chunk_id is null have no hits and are none. Zero vectors score 0. Equal
    queries are answered each. A table without vectors gives no hits.
    """
    if top_k < 1:
        return queries.sparkSession.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double, rank int")
    group = F.col(where) if where else F.lit(0)
    good = queries.filter(usable("vector") & group.isNotNull())
    size = good.select(F.size("vector").cast("long").alias("n")).limit(max_queries + 1).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if size.rows <= max_queries and 8 * (size.n or 0) <= tiles.BLOCK_BYTES:  # bounded: one block
        block = good.select("query", "vector", group.alias("of")).collect()
        kinds = queries.schema["query"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
        return _ranked(_by_broadcast(block, chunks, top_k, where, kinds), top_k).drop("qid")
    return topk_tiles(queries, chunks, top_k, where, made, max_queries)[0]


def topk_texts(queries: DataFrame, chunks: DataFrame, top_k: int, embedder) -> DataFrame:
    """``cosine_topk`` of ``queries(query, vector)`` against the vectors that ``embedder`` makes of ``chunks(chunk_id, text)``. Where it
    has an ``encoder`` and the queries fit one block, a text's vector is made, met and dropped in the task that reads the text.

    With a column ``filter`` (int) of the queries and ``fits`` of the chunks, an array of such numbers, a query that has one is ranked among
    the chunks that list it."""
    filtered = "filter" in queries.columns
    own = F.col("filter").cast("int") if filtered else F.lit(None).cast("int")
    good = queries.filter(usable("vector")).select("query", "vector", own.alias("filter"))
    size = good.select(F.size("vector").cast("long").alias("n")).limit(tiles.BLOCK_ROWS + 1).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if top_k < 1 or not hasattr(embedder, "encoder") or size.rows > tiles.BLOCK_ROWS or 8 * (size.n or 0) > tiles.BLOCK_BYTES:
        return _topk_each(queries, chunks, top_k, embedder, filtered)
    block = [r for r in good.collect() if len(r.vector) == embedder.dim]
    kinds = queries.schema["query"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"qid long, query {kinds[0]}, chunk_id {kinds[1]}, score double"
    if not block:
        return _ranked(queries.sparkSession.createDataFrame([], schema), top_k).drop("qid")
    x = _unit(np.array([r.vector for r in block], float))
    names = pa.array([r["query"] for r in block])
    asks = np.array([-1 if r["filter"] is None else r["filter"] for r in block])
    most = int(asks.max()) + 1

    def run(batches):
        best, encode = tiles.Best(len(block), top_k), embedder.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                score = np.round(x @ _unit(encode(some.column(1)))[order].T, PLACES)
                if most:
                    lists = some.column(2)
                    row, number = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                    listed = np.zeros((most + 1, len(ids)), bool)
                    listed[number[number < most], row[number < most]] = True
                    listed[most] = True  # no filter
                    score[~listed[asks][:, order]] = -np.inf
                best.offer(score, ids[order])
        row, name, score = best.found()
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row), names.take(pa.array(row)), pa.array(name.tolist()), pa.array(score)], names=["qid", "query", "chunk_id", "score"])

    fits = [F.coalesce("fits", F.array().cast("array<int>")).alias("fits")] if most else []
    rows = chunks.filter("chunk_id is not null").select("chunk_id", F.lower("text").alias("text"), *fits)
    return _ranked(rows.mapInArrow(run, schema), top_k).drop("qid")


def _topk_each(queries: DataFrame, chunks: DataFrame, top_k: int, embedder, filtered: bool) -> DataFrame:
    """The same by vectors in a table; with filters a chunk stands once for each that lets it through."""
    if not filtered:
        return cosine_topk(queries, embedder.embed(chunks, ["chunk_id"], "text", "vector"), top_k)
    made = written(embedder.embed(chunks, ["chunk_id"], "text", "vector"), "vectors")
    listed = chunks.select("chunk_id", F.explode("fits").alias("filter"))
    rows = made.withColumn("filter", F.lit(-1)).unionByName(made.join(listed, "chunk_id"))
    asked = queries.withColumn("filter", F.coalesce("filter", F.lit(-1)))
    return cosine_topk(asked, written(rows, "filtered-vectors"), top_k, where="filter")
