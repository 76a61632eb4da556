"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at a cosine of c or more are at a squared distance of 2 - 2c or less. A fixed rotation
spreads that over all coordinates, which are split into BLOCKS blocks (one for each coordinate of a
shorter vector); in one block at least the squared distance is within its share of that budget.
So each block is range-joined under its share: two vectors within a radius have a middle within half
of it from both. Each vector goes to all cells of a grid, WIDE radii wide over the block's first
coordinates, that half the radius reaches; two that meet in a cell are compared by the block's first
coordinates, held as 16-bit numbers with their rounding allowed for. The union of the blocks'
candidates is verified with the cosine of the vectors as given, in double precision.

Equal vectors are one node with a count; their links are not expanded.

Defined cases: a null label, a null, empty or zero vector, or one with a null or non-finite
component links with nothing; vectors of different lengths never link; vectors of any finite size
are scaled by a power of two first, so no product overflows; null ids never become a component's id
unless it has no other; of repeated rows each counts as a link of the other; an empty table gives an
empty one. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

BLOCKS = 8
GRID = 6  # coordinates of a block that the grid takes
WIDE = 6  # width of a cell in radii
PACKED = 8  # coordinates of a block that are compared
UNIT = 32767  # steps from 0 to 1 of a packed coordinate
SEED = 17


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))[0]


def valid(vector: str) -> Column:
    v = F.col(vector)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Components ``x`` of the vectors ``rows``, each vector scaled exactly so that its largest is near 1."""
    top = np.zeros(n)
    np.maximum.at(top, rows, np.abs(x))
    return np.ldexp(x, -np.frexp(top)[1][rows])


def _radius(least: float, size: int) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * least) / min(BLOCKS, size))) * (1 + 1e-9) + 1e-9


def _reached(x: np.ndarray, least: float):
    """Unit vectors, one a row, to (rows, block, cells, first coordinates of the block)."""
    size = x.shape[1]
    half = _radius(least, size) / 2 * (1 + 1e-6)
    width = WIDE * 2 * half
    x = x @ rotation(size)
    for block, part in enumerate(np.array_split(np.arange(size), min(BLOCKS, size))):
        y = x[:, part[:PACKED]]
        grid = y[:, :GRID]
        low = np.floor((grid - half) / width).astype(np.int64)
        high = np.floor((grid + half) / width).astype(np.int64)
        both = (high != low) @ (1 << np.arange(grid.shape[1]))  # half a radius reaches two cells a coordinate at most
        for corner in range(1 << grid.shape[1]):
            rows = np.flatnonzero((both & corner) == corner)
            if not len(rows):
                continue
            up = np.array([corner >> i & 1 for i in range(grid.shape[1])], bool)
            cell = np.where(up, high[rows], low[rows])
            gap = np.maximum(np.maximum(cell * width - grid[rows], grid[rows] - (cell + 1) * width), 0)
            near = (gap**2).sum(1) <= half**2 * (1 + 1e-9)
            if near.any():
                yield rows[near], block, cell[near], y[rows[near]]


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = (key ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _cells(least: float):
    """Nodes to (cell, node, low, high): low and high hold the packed coordinates."""

    def run(batches):
        for batch in batches:
            label, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            flat = _scaled(flat, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                x = flat[begin[of][:, None] + np.arange(size)]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for rows, block, cell, y in _reached(x, least):
                    one = np.ones(len(rows), np.int64)
                    packed = np.zeros((len(rows), PACKED), "<i2")
                    packed[:, : y.shape[1]] = np.rint(y * UNIT)
                    packed = packed.view("<i8")
                    key = _hashed([label[of][rows], one * size, one * block, *cell.T])
                    columns = (key, node[of][rows], packed[:, 0], packed[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["cell", "node", "low", "high"])

    return run


def candidates(nodes: DataFrame, least: float, shortest: int) -> DataFrame:
    """``nodes(label, node, vector)`` to pairs ``(a, b)``, a < b, that are close in a block.
    ``shortest`` is the least length, which has the widest share."""
    cells = nodes.select("label", "node", "vector").mapInArrow(_cells(least), "cell long, node long, low long, high long")
    a, b = cells.alias("a"), cells.alias("b")
    budget = (_radius(least, max(1, shortest)) * UNIT + PACKED**0.5) ** 2
    part = lambda side, i: F.shiftright(F.shiftleft(f"{side}.{'low' if i < 4 else 'high'}", 48 - 16 * (i % 4)), 48)
    gap = [part("a", i) - part("b", i) for i in range(PACKED)]
    near = sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= budget
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") < F.col("b.node")) & near)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs of one label and length whose cosine is ``least`` or more."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("vector").alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            va, vb = (batch.column(i) for i in (2, 3))
            sizes = np.diff(va.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            x, y = (_scaled(v.flatten().to_numpy(zero_copy_only=False).astype(float), row, batch.num_rows) for v in (va, vb))
            dot, xx, yy = (np.bincount(row, w, batch.num_rows) for w in (x * y, x * x, y * y))
            yield batch.select(["a", "b"]).filter(pa.array(dot / np.sqrt(xx * yy) >= least))

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, a row for each row of ``df``."""
    key = ["__h", "__g"]  # 128 bits
    rows = df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(label_col).isNotNull() & valid(vector_col), F.col(label_col).cast("long")).alias("label"),
        F.col(vector_col).alias("vector"),
    )
    rows = rows.withColumns({h: F.when(F.col("label").isNotNull(), F.xxhash64(F.lit(h), "label", "vector")) for h in key})
    nodes = rows.filter("label is not null").groupBy(*key).agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("least")
    )
    # a short name for each, fixed by being written
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    shortest = nodes.agg(F.coalesce(F.min(F.size("vector")), F.lit(1)).alias("n")).first().n
    links = verified(materialize(candidates(nodes, least, shortest), "vector-pairs"), nodes, least)
    links = materialize(links, "vector-links")
    roots = connected_components(links).withColumnRenamed("root", "r")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"))
    counts = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("m"))
    placed = nodes.drop("vector", "label").join(roots, "node", "left").withColumn("r", F.coalesce("r", "node"))
    least_id = placed.groupBy("r").agg(F.min("least").alias("component_id"))
    placed = placed.join(least_id, "r").join(counts, "node", "left")
    facts = placed.select(*key, (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", *key).join(materialize(facts, "vector-facts"), key, "left")
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("__h").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def sql(least: float = 0.98, table: str = "embeddings") -> str:
    """The query's rows in DuckDB's SQL; vectors are taken to be valid or null."""
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as e from {table} where label is not null and embedding is not null),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where {dot('a.e', 'b.e')} / sqrt({dot('a.e', 'a.e')} * {dot('b.e', 'b.e')}) >= {least}),
r as (select vec_id as a, vec_id as b from {table} union select r.a, p.b from r join p on p.a = r.b),
c as (select a, min(b) as component_id from r group by 1),
n as (select a, count(*) as n from p group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from {table} join c on c.a = vec_id left join n on n.a = vec_id"""
