"""Contiguous shards of near-equal bytes.

Rows are range-sorted. Each partition sums the sizes of its rows as they pass (its prefix sums);
the partitions' totals, one row each, give every partition its start; a row goes to the shard in
whose equal share of all bytes its middle lies. No group is gathered and no shard is a task, so
neither a hot key nor a huge shard matters.

Defined cases: null order values come first; rows equal in the order columns follow in the order
they are read, whatever their number; a null size counts as 0; sizes are given, so texts of any length
do; an empty table gives an empty one; columns named as the outputs are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, materialize


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``; equal keys may span partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, "__tie"]
    return tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")


@guarded
def shard_by_bytes(df: DataFrame, n_shards: int, size_col: str, order: list[str]) -> DataFrame:
    """The columns of ``df`` plus ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, the row's
    place in its shard, gapless from 0). All columns are written once to the shared folder, so
    give those that are wanted only."""
    df = df.drop("shard", "slot")
    sized = df.withColumn("__size", F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    schema = sized.limit(0).withColumns(
        {"__part": F.lit(0), "__row": F.lit(0).cast("long"), "__before": F.lit(0).cast("long")}
    ).schema

    def prefix_sums(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            upto = np.cumsum(size) + total
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(len(size), part, np.int32)),
                    pa.array(np.arange(rows, rows + len(size))),
                    pa.array(upto - size),
                ],
                names=schema.names,
            )
            rows, total = rows + len(size), int(upto[-1]) if len(size) else total

    rows = materialize(ranged(sized, order).mapInArrow(prefix_sums, schema), "shard")
    parts = rows.groupBy("__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "__part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("__bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("__rows_ahead"),
        F.sum("bytes").over(Window.partitionBy()).alias("__total"),
    )
    middle = F.col("__bytes_ahead") + F.col("__before") + F.col("__size") * 0.5
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.greatest("__total", F.lit(1)))).cast("int")
    # one row a partition, and one a shard: both are bounded by the caller's settings
    placed = rows.join(F.broadcast(starts), "__part").withColumn("shard", shard)
    placed = placed.withColumn("__row", F.col("__rows_ahead") + F.col("__row"))
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    out = placed.join(F.broadcast(first), "shard")
    return out.select(*df.columns, "shard", (F.col("__row") - F.col("__first")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
