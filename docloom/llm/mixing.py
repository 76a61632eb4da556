"""Mixing sources to target weights, with a curriculum. DataFrame functions only.

1. Targets. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, ... and share the total
   size. No target exceeds ``cap`` times its source's size; what is over is shared by weight
   among the others. That fixed point is min(weight * level, cap * size); the level comes from
   prefix sums over the sources in order of cap * size / weight.
2. Copies. Within a source documents follow each other by a hash. A source with target T and
   size S is passed floor(T / S) times in whole; the rest of T takes one more pass over the
   documents whose middle lies before it. So taken is at most half a document off the target.
3. Positions. A source's weight changes over training time t in [0, 1] as
   1 + tilt * (2t - 1). Integrated and scaled, the source's demand up to t is
   T * ((1 - tilt) * t + tilt * t^2). Inverting it at a copy's place among its source's taken
   words gives the time at which training reaches the copy; documents are range-sorted by it.

Prefix sums run in two steps, within hash ranges of a source and over the ranges' totals, so a
source may hold any share of the rows.

Defined cases: a null or empty text has size 0, takes no words and follows its source's passes; a
null source is a source; rows equal in id and text are taken in some order, alike on each run;
with no rows, or no words at all, targets are 0; a very long document counts by its words like any
other; an empty table gives an empty one; columns named like an output are replaced, others stay.
The sources of a table are few: they share windows of one row a source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, guarded, materialize

RANGES = 1024  # hash ranges of a source
CAP = 3.0
TILTS = (-0.5, 0.0, 0.5)  # of the sources that weigh 1, 2, 3: early, steady, late


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str, text_key: Column | None = None) -> Column:
    """60 bits of the md5 of a row's id (and, where ids repeat, of its text)."""
    what = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    if text_key is not None:
        what = F.concat_ws(" ", what, text_key.cast("string"))
    return F.conv(F.substring(F.md5(what.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """``sizes(src, source, size)``, a row a source, to the same plus ``weight``, ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % len(TILTS) + 1)
    ratio = F.col("size") / F.col("weight")
    before = Window.orderBy(ratio, "src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio, "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(ratio, "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(cap) * F.col("size")
    level = (F.sum("size").over(everything) - cap * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum("weight").over(after)
    # from the first source on that stays below its cap the level holds for all
    least = F.min(F.when(F.col("weight") * F.col("level") <= full, F.struct("ratio", "src", "level"))).over(everything)
    out = ranked.withColumns({"ratio": ratio, "level": level}).withColumn("level", least["level"])
    return out.withColumn("target", F.least(F.col("weight") * F.col("level"), full)).drop("ratio", "level")


@guarded
def mix(df: DataFrame, size_col: str, key: Column, source_col: str = "source", cap: float = CAP) -> DataFrame:
    """The columns of ``df`` plus ``__source_size`` (long), ``__target`` (double), ``__copies``
    (int), ``__before`` (long: the size of what precedes the row in its source) and ``__tilt``.

    ``key`` orders the rows of a source: a long of 60 random bits.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    rows = df.withColumns({"__src": src, "__key": key}).withColumn(
        "__range", F.shiftright("__key", 60 - (RANGES.bit_length() - 1))
    )
    sums = rows.groupBy("__src", "__range", F.col(source_col).alias("source")).agg(F.sum(size_col).alias("part"))
    sources = sums.groupBy(F.col("__src").alias("src"), "source").agg(F.sum("part").alias("size"))
    plan = targets(sources, cap).select(
        F.col("src").alias("__src"),
        F.col("size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.element_at(F.array(*map(F.lit, TILTS)), F.col("weight")).alias("__tilt"),
    )
    ahead = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select("__src", "__range", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("__ahead")).join(plan, "__src")
    within = Window.partitionBy("__src", "__range").orderBy("__key", size_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum(size_col).over(within)).join(places, ["__src", "__range"])
    rows = rows.withColumn("__before", F.col("__ahead") + F.col("__upto") - F.col(size_col))
    passes = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(1))
    rest = F.col("__target") - passes * F.col("__source_size")
    more = (F.col("__before") + F.col(size_col) * 0.5 <= rest) & (rest > 0)
    rows = rows.withColumn("__copies", (passes + more.cast("int")).cast("int"))
    return rows.select(*df.columns, "__source_size", "__target", "__copies", "__before", "__tilt")


def position(copy: Column, size_col: str) -> Column:
    """The training time from 0 to 1 at which a copy of a row of ``mix`` is reached."""
    place = copy * F.col("__source_size") + F.col("__before") + F.col(size_col) * 0.5
    u = F.when(F.col("__target") > 0, F.least(place / F.col("__target"), F.lit(1.0))).otherwise(F.lit(0.5))
    b = F.col("__tilt")
    return 2 * u / ((1 - b) + F.sqrt((1 - b) * (1 - b) + 4 * b * u))


def _tie(rows: DataFrame, columns: list[str]) -> Column:
    """Orders rows of one position alike, however they are laid out: a hash of the columns (maps aside)."""
    return F.xxhash64(*(c for c in columns if "map<" not in rows.schema[c].dataType.simpleString()))


def _ranged(rows: DataFrame, *ties: Column | str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "__position", *ties).sortWithinPartitions("__position", *ties)


def train_order(mixed: DataFrame, size_col: str, keep: list[str]) -> DataFrame:
    """A row for each copy, range-sorted by ``__position``, the training time from 0 to 1; rows of one time by
    a hash of what they hold, then by copy, so the order is the same for any layout of the input."""
    copies = mixed.filter(
        "__copies > 0"
    ).withColumn("__copy", F.explode(F.expr("sequence(0, __copies - 1)")))
    rows = copies.withColumn("__position", position(F.col("__copy"), size_col)).select(*keep, "__position", "__copy")
    return _ranged(rows, _tie(rows, keep), "__copy")


def first_order(mixed: DataFrame, size_col: str) -> DataFrame:
    """The rows of ``mix`` range-sorted by ``__position``, that of their first copy; rows without
    a copy come last, from 2 on by their place in the source, so that they are not all one value."""
    place = F.col("__before") / F.greatest(F.col("__source_size"), F.lit(1))
    first = F.when(F.col("__copies") > 0, position(F.lit(0), size_col)).otherwise(2 + place)
    rows = mixed.withColumn("__position", first)
    return _ranged(rows, _tie(rows, mixed.columns))


def rank_in_order(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``position``: the place of each, from 0, in the frame that was written to the files
    that it reads, however those are split. A frame that reads no files is written first."""
    where = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        tagged = rows.select("*", *where)
    except AnalysisException:
        tagged = materialize(rows, "in-order").select("*", *where)
    part = F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long")
    ahead = Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = tagged.groupBy("__file").count().select("__file", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    return tagged.join(F.broadcast(files), "__file").select(*rows.columns, (F.col("__ahead") + F.col("__row")).alias("position"))


def sql(table: str = "documents") -> str:
    """The query's rows in DuckDB's SQL."""
    whole = "over (order by ratio, k rows between unbounded preceding and unbounded following)"
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '-')), 1, 15))::bigint as key from {table}),
s as (select source, coalesce('=' || source, '-') as k, sum(size)::bigint as size from d group by 1, 2),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
r as (select *, size / weight as ratio from w),
l as (select *, (sum(size) {whole} - {CAP}::double * coalesce(sum(size) over (order by ratio, k rows between unbounded preceding and 1 preceding), 0)::double)::double
  / (sum(weight) over (order by ratio, k rows between current row and unbounded following))::double as level from r),
f as (select arg_min(level, (ratio, k)) as level from l where weight * level <= {CAP}::double * size),
t as (select source, k, size as source_size, least(weight * f.level, {CAP}::double * size) as target, {list(TILTS)}[weight]::double as tilt from r, f),
o as (select d.*, t.source_size, t.target, t.tilt, sum(d.size) over (partition by t.k order by key rows unbounded preceding) - d.size as before
  from d join t on t.k = coalesce('=' || d.source, '-')),
c as (select *, case when source_size > 0 then floor(target / source_size) else 1 end as passes,
  case when target > 0 then least((before + size * 0.5::double) / target, 1.0::double) else 0.5::double end as u from o),
n as (select *, (passes + (before + size * 0.5 <= target - passes * source_size and target - passes * source_size > 0)::int)::bigint as copies from c)
select doc_id, size, source_size, target, (size * copies)::bigint as taken,
  case when copies > 0 then round_even(2 * u / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)), 9) end as first_position from n"""
