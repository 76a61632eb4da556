"""Blocks of rows that meet blocks of other rows.

A table of any size is cut into blocks of bounded size. A tile is a pair of blocks; all tiles of a left block
that fall into one group stand together, the left rows first, so a task holds one left block and streams the
right rows past it in Arrow batches. Left blocks and right batches are bounded, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
BLOCK_BYTES = 8 << 20  # of a block's vectors, as doubles
TASKS = 3  # tiles' groups for each shuffle partition


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(spark: SparkSession, left_blocks: int) -> int:
    """Into how many groups the right side is dealt, so that all tasks have work and each left block is
    sent no more often than that."""
    return max(1, -(-TASKS * partitions(spark) // max(1, left_blocks)))


def numbered(
    rows: DataFrame, by: list[str], order: list[Column | str], weight: str | None = None, block_rows: int = BLOCK_ROWS, loose: list[str] | None = None
) -> DataFrame:
    """``rows`` plus ``block`` (long): neighbours in the order of ``by``, ``loose`` and ``order`` share one, at most
    ``block_rows`` of them, fewer where the vectors in ``weight`` are long. A block holds one value of ``by``, and of ``loose``
    too where a quarter of a block has it: blocks of few rows would make the other side move for each of them."""
    loose = loose or []
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *by, *loose, *order).sortWithinPartitions(*by, *loose, *order)
    ranged = ranged.withColumn("__part", F.spark_partition_id())
    of = [ranged.columns.index(c) for c in by]
    soft = [ranged.columns.index(c) for c in loose]
    long = ranged.columns.index(weight) if weight else None
    schema = ranged.drop("__part").withColumn("block", F.lit(0).cast("long")).schema

    def run(batches):
        block, held, last, now = -1, 0, None, None
        for batch in batches:
            part = batch.column(batch.num_columns - 1)
            keys = list(zip(*(batch.column(i).to_pylist() for i in of))) if of else [()] * batch.num_rows
            parts = list(zip(*(batch.column(i).to_pylist() for i in soft))) if soft else keys
            width = np.diff(batch.column(long).offsets.to_numpy()) if long is not None else None
            out = np.zeros(batch.num_rows, np.int64)
            for i, key in enumerate(keys):
                most = block_rows if width is None else max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, int(width[i])))))
                if key != last or held >= most or block < 0 or parts[i] != now and 4 * held >= most:
                    block, held, last = block + 1, 0, key
                now = parts[i]
                held += 1
                out[i] = block
            first = part[0].as_py() if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out + (first << 32))], names=schema.names)

    return ranged.mapInArrow(run, schema)


def stream(left: DataFrame, right: DataFrame, run: Callable, schema: str, *order: str) -> DataFrame:
    """``run`` on the rows of both, those of one ``(left_block, tile_group)`` together: left rows (side 0), then right
    rows (side 1) in the given order. The two keys and ``side`` are the first columns."""
    keys = ["left_block", "tile_group", "side"]
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    dealt = both.select(*keys, *rest).repartition(*keys[:2]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches of ``stream`` in slices of one (left_block, tile_group, side) each, and of one value of each of the
    integer columns ``more``, of BLOCK_ROWS rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        change = np.zeros(batch.num_rows, bool)
        for k in [*keys, *(batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in more)]:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            for at in range(a, b, BLOCK_ROWS):
                yield tuple(int(k[a]) for k in keys), batch.slice(at, min(BLOCK_ROWS, b - at))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


class Best:
    """The best k of each of some rows: higher scores first, smaller names first on a tie. Scores are doubles, or
    longs where ``kind`` says so; the least value of the kind (``none``) is no score."""

    def __init__(self, rows: int, k: int, kind: type = np.float64):
        self.k, self.kind = k, kind
        self.none = -np.inf if kind is np.float64 else np.iinfo(kind).min
        self.least = np.full(rows, self.none, kind)  # what a score must reach
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = 0

    def _down(self, score: np.ndarray) -> np.ndarray:
        return -score if self.kind is np.float64 else ~score

    def add(self, row: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        if len(row):
            self._parts.append((row, name, score))
            self._held += len(row)
            if self._held > 4 * self.k * len(self.least) + 4096:
                self._compact()

    def offer(self, scores: np.ndarray, names: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``scores``: a row for each of ``rows``, a column for each of the ascending ``names``."""
        rows = np.arange(len(scores)) if rows is None else rows
        n = scores.shape[1]
        cut = self.least[rows]
        reach = np.flatnonzero(scores.max(1, initial=self.none) >= np.maximum(cut, self.none))
        scores, rows, cut = scores[reach], rows[reach], cut[reach]
        if n > self.k and len(rows):
            cut = np.maximum(cut, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        good = (scores >= cut[:, None]) & (scores > self.none)
        for i in np.flatnonzero(good.sum(1) > self.k):  # ties at the cut: the smaller names
            at = np.flatnonzero(good[i])
            good[i] = False
            good[i, at[np.argsort(self._down(scores[i, at]), kind="stable")[: self.k]]] = True
        i, j = np.nonzero(good)
        self.add(rows[i], names[j], scores[i, j])

    def _compact(self) -> None:
        row, name, score = (np.concatenate(x) for x in zip(*self._parts))
        order = np.lexsort((name, self._down(score), row))
        row, name, score = row[order], name[order], score[order]
        begin = np.r_[True, row[1:] != row[:-1]]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(begin, np.arange(len(row)), 0))
        keep = place < self.k
        full = place == self.k - 1
        self.least[row[full]] = score[full]
        self._parts, self._held = [(row[keep], name[keep], score[keep])], int(keep.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, name, score), by row and rank."""
        if not self._parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self._compact()
        return self._parts[0]
