"""Hard negatives by Kronecker-packed products.

Components become integers, floor(SCALE * c), and a row's score is its integer inner product with an anchor.
Several candidates are packed into one word: each candidate's components are biased to be no less
than 0 and stand in fields of the word, wide enough for the greatest sum of products. One product of the word with
the anchor's (biased) component multiplies all fields at once; summed over the components each field holds one
candidate's sum, and taking the biases out gives the scores, exact. A word is a double's 53 bits where two fields
fit, else 63 bits, else as wide as eight fields need.

Anchors stand in blocks that candidates stream past (``operators/tiles.py``), twice:

1. blocks of one label meet the rows of that label, and keep each anchor's best: its positives;
2. blocks of any anchors, with their positives' scores, meet all rows, and keep for each anchor and positive
   the best rows of another label within the window that the positive's score sets.

A task holds one block and a slice of candidates, whatever share of the rows a label or a vector has.

Defined cases: rows with a null id, label or vector, or with a component that is null or not finite, take no part;
neither do empty vectors; vectors of different lengths never meet; a score beyond a long counts as the nearest long
(at least -2^63 + 1); repeated rows are rows of their own, so a repeated anchor has its rows repeated; an anchor
without positives, or a positive without a row in its window, has no row; a negative positive score has an empty
window; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tiles
from ..operators.retrieval import small
from .common import materialize
from .whitening import valid, whole

SCALE = 256
MANTISSA, WORD = 53, 63
WIDE_FIELDS = 8
MOST = (1 << 63) - 1


def integers(column: pa.Array, size: int) -> np.ndarray:
    return whole(column, size, SCALE)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of two tables of integer vectors, a row an anchor, as longs."""
    m, d = anchors.shape
    low_a, low_x = int(anchors.min(initial=0)), int(candidates.min(initial=0))
    a, u = anchors - low_a, candidates - low_x
    width = max(1, (d * int(a.max(initial=0)) * int(u.max(initial=0))).bit_length())
    fields = MANTISSA // width
    kind: type = float
    if fields < 2:
        fields, kind = WORD // width, np.int64
    if fields < 2:
        fields, kind = WIDE_FIELDS, object
    u = np.vstack([u, np.zeros((-len(u) % fields, d), u.dtype)])
    parts = u.reshape(-1, fields, d).astype(object if kind is object else np.int64)
    words = parts[:, 0].copy()
    for t in range(1, fields):
        words += parts[:, t] << width * t
    products = a.astype(kind) @ words.astype(kind).T  # a product for each anchor's component and word
    products = products if kind is object else products.astype(np.int64)
    mask = (1 << width) - 1
    out = np.stack([products >> width * t & mask for t in range(fields)], axis=2).reshape(m, -1)[:, : len(candidates)]
    sums = [x.astype(object).sum(1) if kind is object else x.sum(1) for x in (a, u[: len(candidates)])]
    out = out + (low_x * sums[0][:, None] + low_a * sums[1][None, :] + d * low_a * low_x)
    if kind is object:
        out = np.clip(out, -MOST, MOST)
    return out.astype(np.int64)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest s with low * score <= 100 * s <= high * score."""
    return max(-MOST, -(-low * score // 100)), min(MOST, high * score // 100)


def _tasks(left_columns: list[str], per_anchor: int, top_k: int, offer, schema: str):
    """A function on ``tiles.stream``: ``offer`` adds a slice's scores to the best of a block's rows, of which there are
    ``per_anchor`` for each anchor."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        key, left, best = None, [], None

        def done():
            if best is not None:
                row, name, score = best.found()
                at = pa.array(row // per_anchor)
                made = {"nth": pa.array((row % per_anchor).astype(np.int32)), "other": pa.array(name), "score": pa.array(score)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else block[c].take(at) for c in names], names=names)

        for (number, group, side), batch in tiles.runs(batches):
            if (number, group) != key:
                yield from done()
                key, left, best = (number, group), [], None
            if side == 0:
                left.append(batch)
                continue
            if not left:  # no anchor was dealt to this block
                continue
            if best is None:
                block = {c: pa.concat_arrays([b.column(c) for b in left]) for c in left_columns}
                sizes = np.diff(block["vector"].offsets.to_numpy())
                by_size = {n: (at := np.flatnonzero(sizes == n), integers(block["vector"].take(pa.array(at)), n)) for n in np.unique(sizes).tolist()}
                best = tiles.Best(len(sizes) * per_anchor, top_k, np.int64)
            ids = batch.column("id").to_numpy()
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            order = np.argsort(ids, kind="stable")
            for n, (at, x) in by_size.items():
                mine = order[lengths[order] == n]
                if len(mine):
                    some = batch.take(pa.array(mine))
                    offer(best, block, at, some, scores(x, integers(some.column("vector"), n)))
        yield from done()

    return run


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``anchor`` holds, a condition on ``df``. Each has as positives its best
    ``positives`` other rows of the same label; each positive has as negatives the best ``negatives`` rows of other labels
    with a score of ``low`` to ``high`` percent of the positive's. Of equal scores the smaller id is better.
    """
    rows = df.filter(valid(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks")
    )
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    spark, others = rows.sparkSession, rows.select("uid", "id", "label", "vector")
    asked = rows.filter("asks").drop("asks")

    # 1. positives: blocks of one label
    blocks = materialize(tiles.numbered(asked, ["label"], ["uid"], "vector", tiles.BLOCK_ROWS).withColumnRenamed("block", "left_block"), "negatives-anchors")
    of = blocks.select("label", "left_block").distinct()
    n = tiles.groups(spark, of.count())
    group = F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("tile_group")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile_group")
    left = blocks.select("left_block", every, "uid", "id", "vector")
    right = others.join(small(of), "label").select("left_block", group, "uid", "id", "vector")

    def same_label(best, block, at, some, found):
        own = block["uid"].take(pa.array(at)).to_numpy()[:, None] == some.column("uid").to_numpy()[None, :]
        best.offer(np.where(own, best.none, found), some.column("id").to_numpy(), at)

    schema = "uid long, id long, other long, score long"
    hits = tiles.stream(left, right, _tasks(["uid", "id", "vector"], 1, positives, same_label, schema), schema)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "other")
    hits = hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    listed = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "score"))).alias("p"))
    listed = materialize(listed.select("uid", F.col("p.other").alias("positive"), F.col("p.score").alias("positive_score")), "negatives-positives")

    # 2. negatives: blocks of any anchors, all rows
    n_left = max(1, -(-listed.count() // tiles.BLOCK_ROWS))
    n = tiles.groups(spark, n_left)
    group = F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("tile_group")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile_group")
    number = F.pmod(F.xxhash64(F.lit("block"), "uid"), F.lit(n_left)).alias("left_block")
    left = asked.join(listed, "uid").select(number, every, "uid", "id", "label", "vector", "positive", "positive_score")
    right = others.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("left_block"), group, "id", "label", "vector")

    def other_label(best, block, at, some, found):
        labels = block["label"].take(pa.array(at)).to_numpy()[:, None] != some.column("label").to_numpy()[None, :]
        listed = [block["positive_score"][int(i)].as_py() for i in at]
        for k in range(positives):
            bounds = np.array([_window(p[k], low, high) if k < len(p) else (MOST, -MOST) for p in listed], np.int64)
            inside = labels & (found >= bounds[:, :1]) & (found <= bounds[:, 1:])
            if inside.any():
                best.offer(np.where(inside, found, best.none), some.column("id").to_numpy(), at * positives + k)

    schema = "uid long, id long, positive array<long>, positive_score array<long>, nth int, other long, score long"
    columns = ["uid", "id", "label", "vector", "positive", "positive_score"]
    found = tiles.stream(left, right, _tasks(columns, positives, negatives, other_label, schema), schema)
    found = found.withColumns({c: F.get(c, F.col("nth")) for c in ("positive", "positive_score")})
    order = Window.partitionBy("uid", "nth").orderBy(F.desc("score"), "other")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= negatives)
        .select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def sql(table: str = "embeddings") -> str:
    """The query's rows in DuckDB's SQL; vectors are taken to be valid or null, ids not to repeat."""
    return f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding::double[], lambda x: floor({SCALE} * x)) as e from {table} where label is not null and embedding is not null),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, id) as nth from s where same),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.nth <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
