"""Dedup of lines over a corpus. DataFrame functions only.

1. Each line's key (stripped, A-Z in lower case) is hashed to 128 bits where the text lies; only
   (hash, document, position) moves.
2. These rows are range-partitioned by hash and document, with a secondary sort by document and position,
   so a line of any frequency spreads over as many ranges as it fills. A stream over that order finds
   each document's first occurrence of a line; their number is the number of documents that have it.
3. Hashes of enough documents are joined back and give the positions to drop. A document's positions
   become a bitmap of 64-bit words; words in which every line stays are left out.
4. The bitmaps are returned instead of texts; ``kept_text`` applies them.

Documents are rows, told apart by the file and the row they are read from (a frame that reads no files is
written first), so repeated rows and ids are documents of their own.

Defined cases: a null or empty text is one empty line, and stays so; lines whose key is shorter than
``min_chars`` are never dropped; a very long text is split in the row that holds it; a document that
loses all lines keeps the empty text; an empty table gives an empty one; columns of the input named like
those of the operator are replaced, others stay.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, materialize, release

MIN_DOCS = 10
MIN_CHARS = 1
WORD_BITS = 64
BROADCAST_BYTES = 32 << 20
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH, _DOC = ["__h", "__g"], ["__file", "__row"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    # translate makes a string of each character; where all are ASCII, lower changes A-Z alone
    folded = F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.btrim(folded, F.lit(SPACES))


def _tagged(df: DataFrame) -> DataFrame:
    """``df`` plus the file and row that each of its rows is read from."""
    where = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return df.select("*", *where)
    except AnalysisException:
        return materialize(df, "lines-docs").select("*", *where)


def occurrences(docs: DataFrame, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(__h, __g, __file, __row, __at)``: hash, document and position of each line with a key."""
    rows = docs.select(*_DOC, F.posexplode(F.transform(split_lines(F.col(text_col)), line_key)).alias("__at", "__key"))
    rows = rows.filter((F.col("__key") != "") & (F.length("__key") >= min_chars))
    # two seeds: 128 bits tell lines apart
    return rows.select(F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit("line"), "__key").alias("__g"), *_DOC, "__at")


def _ranged(rows: DataFrame) -> DataFrame:
    """Ranges by hash and document, in the order of hash, document and position."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *_HASH, *_DOC).sortWithinPartitions(*_HASH, *_DOC, "__at")


def repeated(ranged: DataFrame, min_docs: int) -> DataFrame:
    """``(__h, __g, __docs, __first)``: the hashes of ``min_docs`` documents or more, and the first document and
    position of each. The window's key and order are those of the ranges: nothing moves for it, and of a
    frequent line each range sends on one row."""
    stream = Window.partitionBy(*_HASH, *_DOC).orderBy("__at")
    firsts = ranged.withColumn("__n", F.row_number().over(stream)).filter("__n = 1")
    counts = firsts.groupBy(*_HASH).agg(F.count("*").alias("__docs"), F.min(F.struct(*_DOC, "__at")).alias("__first"))
    return counts.filter(F.col("__docs") >= min_docs)


def _few_files(table: DataFrame) -> DataFrame:
    """Small tables of many ranges are written by as many tasks as there are cores, not in a file for each range."""
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def _bounded(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast only if counting finds it within BROADCAST_BYTES."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


@guarded
def line_bitmaps(
    df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """The columns of ``df`` but the text, plus ``__n_lines``, ``__n_dropped`` (long) and ``__bitmap``.

    Lines whose key is in ``min_docs`` documents or more are dropped everywhere; with ``keep_first`` the first
    in the order of documents (file, then row) and positions stays. ``__bitmap`` is an array of (word, bits):
    bit i of a word says that line 64 * word + i stays; words that are not listed have all their bits set.
    """
    rest = [c for c in df.columns if c != text_col]
    return _with_bitmaps(df, text_col, rest, min_docs, min_chars, keep_first)


def _with_bitmaps(df: DataFrame, text_col: str, keep: list[str], min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """The columns ``keep`` with each document's bitmap."""
    docs = _tagged(df)
    rows = materialize(occurrences(docs, text_col, min_chars), "lines")
    often = materialize(_few_files(repeated(_ranged(rows), max(1, min_docs))), "lines-often")
    hit = rows.join(_bounded(often, 40), _HASH)
    if keep_first:
        hit = hit.filter(F.struct(*_DOC, "__at") != F.col("__first"))
    bit = F.expr(f"shiftleft(1L, __at % {WORD_BITS})")
    word = (F.col("__at") / WORD_BITS).cast("int").alias("word")
    words = hit.groupBy(*_DOC, word).agg(F.bit_or(bit).alias("gone"))
    dropped = words.groupBy(*_DOC).agg(
        F.sum(F.bit_count("gone")).alias("__n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("__bitmap")
    )
    dropped = materialize(_few_files(dropped), "lines-bitmaps")
    release(rows, often)
    n_lines = F.size(split_lines(F.col(text_col))).cast("long").alias("__n_lines")
    # the bitmaps grow with the documents, so both sides are shuffled at any size
    out = docs.select(*keep, n_lines, *_DOC).join(dropped.hint("merge"), _DOC, "left")
    none = F.array().cast(dropped.schema["__bitmap"].dataType)
    return out.select(
        *keep, "__n_lines", F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("__n_dropped"), F.coalesce("__bitmap", none).alias("__bitmap")
    )


def dropped_positions(bitmap: Column) -> Column:
    """The lines, from 0, whose bit is not set."""
    numbers = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    gone = F.transform(
        bitmap, lambda w: F.transform(F.filter(numbers, lambda i: F.getbit(w["bits"], i) == 0), lambda i: w["word"] * WORD_BITS + i)
    )
    return F.flatten(gone)


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, joined by line ends."""

    def kept(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped_positions(bitmap))
        return F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")

    whole = F.coalesce(text, F.lit(""))
    # the lines are bound to a name, so that they are split once and not for each line
    return F.when(F.size(bitmap) == 0, whole).otherwise(F.transform(F.array(split_lines(text)), kept)[0])


@guarded
def drop_lines(
    df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """``df`` with the bitmaps applied to its texts, plus ``__n_lines`` and ``__n_dropped``."""
    out = _with_bitmaps(df, text_col, df.columns, min_docs, min_chars, keep_first)
    return out.withColumn(text_col, kept_text(F.col(text_col), F.col("__bitmap"))).select(*df.columns, "__n_lines", "__n_dropped")


def sql(table: str = "documents", min_docs: int = MIN_DOCS) -> str:
    """The query's rows in DuckDB's SQL."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from {table}),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, translate(trim(line, {spaces}), '{UPPER}', '{LOWER}') as key from l),
f as (select key from k where key <> '' group by key having count(distinct r) >= {min_docs}),
s as (select r, doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '') as kept from k left join f using (key) group by r, doc_id)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from s"""
