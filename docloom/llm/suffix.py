"""Exact removal of long repeated substrings by distributed prefix doubling.

Every byte that a string of ``length`` bytes covers goes if the string starts anywhere else in
the corpus too. Names (ranks) of strings are made by doubling: the name of 2m bytes at p is the
pair of the names of m bytes at p and p + m. Up to 32 bytes the pairs are combined where the
text lies. Ranking each byte of a corpus beyond that would sort some eight rows a byte and
round, so the ranks that Spark sorts are anchored:

1. Of the 32-byte names in a window of ``length`` bytes the least is its anchor (the first of
   equals). Equal windows have equal anchors at equal offsets. About one byte in 70 is an
   anchor; the windows of one anchor follow each other and make its context.
2. Spark groups anchors by name. Unique ones are done: nothing in their contexts repeats.
3. Contexts are ranked next. One that occurs twice repeats in whole.
4. Different contexts of one anchor are compared at growing lengths. The windows of a context
   are dealt to nodes of 32, then 4, then 1 neighbours. The strings that all windows of a node
   share have ``length`` - 31, ``length`` - 3 and ``length`` bytes: a node whose string is
   unique among the anchor's contexts drops out, one that repeats with all its windows is
   done, the others are ranked again at the next length.

The result is that of a suffix array: a string is never compared by its prefix only, and no
occurrence is dropped. Names are 64-bit hashes within groups of equal 64-bit anchors.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; each of
several equal texts (rows of one doc_id too) of at least ``length`` bytes loses everything,
for each repeats the other; very long texts are named in pieces of PIECE bytes that overlap, so
nothing is lost between them; an empty table gives an empty one; other columns stay, but those named
like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, release, slices, text_bytes, text_key

GRAM = 32
WIDTHS = (32, 4, 1)
OUT_ROWS = 250  # texts that are cut at a time
PIECE = 1 << 19  # bytes of text that are named at a time
BROADCAST_KEYS = 1_000_000  # keys are sent to all executors up to this many, joined beyond
POSITION = np.uint64((1 << 24) - 1)


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the GRAM bytes at each position, by doubling."""
    name = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    name ^= name >> np.uint64(29)
    size = 1
    while size < GRAM:
        pair = name[:-size] * np.uint64(0xBF58476D1CE4E5B9)
        pair += name[size:]
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0x94D049BB133111EB)
        pair ^= pair >> np.uint64(30)
        name, size = pair, size * 2
    return name


def window_anchors(names: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the position of its anchor."""
    width = length - GRAM + 1
    best = (names & ~POSITION) | np.arange(len(names), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best, size = np.minimum(best[:-size], best[size:]), size * 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & POSITION).astype(np.int64)


def contexts(texts: list[bytes], length: int):
    """(text number, first window, windows, left reach, anchor name, context name) as arrays."""
    raw = b"".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 6
    names = gram_names(np.frombuffer(raw, np.uint8))
    anchor = window_anchors(names, length)
    at = np.repeat(np.arange(len(texts)), size)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= end[at]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(anchor)])
    keep = inside[first]
    first, count = first[keep], count[keep]
    digest = xxhash.xxh3_64_digest
    whole = b"".join(
        [digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count - 1 + length).tolist())]
    )
    return [
        at[first],
        first - (end - size)[at[first]],
        count,
        anchor[first] - first,
        names[anchor[first]].view(np.int64),
        np.frombuffer(whole, np.int64),
    ]


def _pieces(text: bytes, length: int):
    for a in range(0, max(1, len(text) - length + 1), PIECE):
        yield a, text[a : a + PIECE + length - 1]


def _anchors(length: int):
    def run(batches):
        seen: set = set()  # a text is named once in a task
        part: list[tuple[int | bytes, int, bytes]] = []
        room = 0

        def flush():
            no, first, count, reach, anchor, name = contexts([x[2] for x in part], length)
            key = pa.array([x[0] for x in part]).take(pa.array(no))
            base = np.array([x[1] for x in part], np.int64)[no]
            part.clear()
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, (anchor, name)), key, *map(pa.array, (first + base, count.astype(np.int32), reach.astype(np.int32)))],
                names=["g", "c", "t", "lo", "n", "reach"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i]
                if key in seen:
                    continue
                seen.add(key)
                for base, piece in _pieces(text.as_py(), length):
                    part.append((key, base, piece))
                    room += len(piece)
                    if room >= PIECE:
                        yield flush()
                        room = 0
        if part:
            yield flush()

    return run


def _nodes(width: int, length: int):
    """Contexts, with the nodes of the level above that are still open, to their nodes here."""

    def run(batches):
        digest = xxhash.xxh3_64_digest
        for batch in slices(batches, 2000):
            out, core, whole = [], [], []
            for g, c, reach, n, text, above in zip(*(x.to_pylist() for x in batch.columns)):
                least = reach - n + 1
                if above is None:
                    starts = range(least // width * width, reach + 1, width)
                else:
                    up = WIDTHS[WIDTHS.index(width) - 1]
                    starts = [s for p in above for s in range(p, p + up, width) if s <= reach and s + width > least]
                for s in starts:
                    e = s + width - 1
                    a, b = max(s, least), min(e, reach)
                    out.append((g, c, reach, s, a, b))
                    core.append(digest(text[reach - s : reach + length - e]))
                    whole.append(digest(text[reach - b : reach - a + length]))
            cols = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[:, i]) for i in (0, 1)]
                + [pa.array(cols[:, i].astype(np.int32)) for i in (2, 3, 4, 5)]
                + [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (core, whole)],
                names=["g", "c", "reach", "s", "a", "b", "core", "whole"],
            )

    return run


def _twice(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in two rows or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")


def _few(keys: DataFrame) -> tuple[DataFrame, bool]:
    few = keys.count() <= BROADCAST_KEYS
    return (F.broadcast(keys) if few else keys), few


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """``docs(t, text)``, t a key of the text, to ``(t, first, last)``: runs of window starts
    whose strings of ``length`` bytes occur elsewhere. Equal texts are to be looked for apart."""
    kind = docs.schema["t"].dataType.simpleString()
    rows = docs.mapInArrow(_anchors(length), f"g long, c long, t {kind}, lo long, n int, reach int")
    # counted, and the counts written, before they are joined, here and below: between two tables
    # Spark splits a name that a third of the texts share
    names = materialize(rows, "suffix-names")
    rows = materialize(names.join(materialize(_twice(names.select("g"), "g"), "suffix-twice"), "g"), "suffix-anchors")
    release(names)
    ctx = materialize(
        rows.groupBy("g", "c").agg(
            F.count("*").alias("k"),
            F.min(F.struct("t", "lo")).alias("at"),
            F.first("n").alias("n"),
            F.first("reach").alias("reach"),
        ),
        "suffix-contexts",
    )
    done = [ctx.filter("k > 1").select("g", "c", F.lit(0).alias("j0"), (F.col("n") - 1).alias("j1"))]
    some = ctx.join(materialize(_twice(ctx, "g"), "suffix-several"), "g")
    some = materialize(some.select("g", "c", "reach", "n", F.col("at.t").alias("t"), F.col("at.lo").alias("lo")), "suffix-open")
    keys, _ = _few(materialize(some.select("t").distinct(), "suffix-texts"))
    texts = docs.join(keys, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    cut = F.substring(F.col("text"), F.col("lo").cast("int") + 1, F.col("n") - 1 + length)
    some = materialize(some.join(texts, "t").select("g", "c", "reach", "n", cut.alias("text")), "suffix-strings")
    open_ = some.withColumn("above", F.lit(None).cast("array<int>"))
    for width in WIDTHS:
        nodes = open_.select("g", "c", "reach", "n", "text", "above").mapInArrow(
            _nodes(width, length),
            "g long, c long, reach int, s int, a int, b int, core long, whole long",
        )
        nodes = materialize(nodes, "suffix-nodes")
        if width > 1:
            full = nodes.groupBy("g", "a", "b", "whole").agg(F.count("*").alias("k"), F.min("c").alias("head"))
            full = materialize(full.filter("k > 1").drop("k"), "suffix-full")
            nodes = nodes.join(full, ["g", "a", "b", "whole"], "left")
        else:
            nodes = nodes.withColumn("head", F.col("c"))
        # a node that is done still answers for those that aren't, by one context for all alike
        ranks = nodes.groupBy("g", "s", "core").agg(F.count("*").alias("k"), F.max(F.col("head").isNull()).alias("more"))
        nodes = nodes.join(materialize(ranks.filter("k > 1").drop("k"), "suffix-ranks"), ["g", "s", "core"])
        if width > 1:
            nodes = materialize(nodes, "suffix-level")
            still = nodes.filter("head is null or more and head = c")
            open_ = some.join(still.groupBy("g", "c").agg(F.collect_list("s").alias("above")), ["g", "c"])
            nodes = nodes.filter("head is not null")
        done.append(nodes.select("g", "c", (F.col("reach") - F.col("b")).alias("j0"), (F.col("reach") - F.col("a")).alias("j1")))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    runs = materialize(found.groupBy("g", "c").agg(F.collect_list(F.struct("j0", "j1")).alias("runs")), "suffix-runs")
    return (
        rows.join(runs, ["g", "c"])
        .select("t", "lo", F.explode("runs").alias("r"))
        .select("t", (F.col("lo") + F.col("r.j0")).alias("first"), (F.col("lo") + F.col("r.j1")).alias("last"))
    )


def removed_runs(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of bytes to remove, from runs of window starts."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order] + length)
    begins = np.flatnonzero(np.r_[True, first[1:] > upto[:-1]])
    return first[begins], upto[np.r_[begins[1:] - 1, len(first) - 1]]


def _cut(text: bytes, first: np.ndarray, last: np.ndarray, whole: bool, length: int, characters: bool) -> tuple[bytes, int]:
    """What remains of a text, and how many runs were removed. With ``characters``, what a cut leaves of
    a character goes too."""
    if whole:
        return b"", min(1, len(text))
    if not len(first):
        return text, 0
    begin, end = removed_runs(first, last, length)
    parts = [text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)])]
    if characters:
        parts = [x.decode("utf-8", "ignore").encode() for x in parts]
    return b"".join(parts), len(begin)


def _keyed(df: DataFrame, text_col: str, length: int) -> tuple[Column, DataFrame]:
    """A key of texts, and the keys of texts of ``length`` or more that occur twice. The key has 64 bits
    unless two different texts would share it, then 128."""
    text = text_bytes(text_col)
    other = F.xxhash64(F.lit(1), text)
    long_ = df.filter(F.octet_length(text) >= length)
    twice = long_.groupBy(F.xxhash64(text).alias("t")).agg(F.count("*").alias("n"), F.min(other).alias("lo"), F.max(other).alias("hi"))
    twice = materialize(twice.filter("n > 1"), "suffix-copies")
    if twice.filter("lo <> hi").isEmpty():
        return F.xxhash64(text), twice.select("t")
    key = text_key(text_col)
    return key, materialize(_twice(long_.select(key.alias("t")), "t"), "suffix-copies")


@guarded
def remove_repeats(df: DataFrame, text_col: str = "text", length: int = 200, characters: bool = False) -> DataFrame:
    """The columns of ``df`` but the text, plus ``__kept`` (binary, the bytes that remain of it),
    ``__n_bytes``, ``__n_removed`` and ``__n_spans`` (long). With ``characters``, ``__kept`` leaves out
    what a cut leaves of a character."""
    if length < 2 * GRAM + WIDTHS[0]:
        raise ValueError(f"length must be at least {2 * GRAM + WIDTHS[0]}")
    key, copies = _keyed(df, text_col, length)
    copies = copies.withColumn("whole", F.lit(True))
    docs = df.select(key.alias("t"), text_bytes(text_col).alias("text"))
    long_ = docs.filter(F.octet_length("text") >= length)
    spans = repeated_windows(long_, length).groupBy("t").agg(
        F.collect_list(F.struct("first", "last")).alias("windows")
    )
    found = materialize(spans.join(copies, "t", "full"), "suffix-spans")
    tagged = df.withColumn("__t", key).withColumn("__text", text_bytes(text_col)).drop(text_col)
    keys, few = _few(found.select(F.col("t").alias("__t")))
    found = found.withColumnRenamed("t", "__t").withColumnsRenamed({"windows": "__windows", "whole": "__whole"})
    if few:  # texts without a repeat then need not move
        hit = tagged.join(keys, "__t", "left_semi").join(found, "__t", "left")
        miss = tagged.join(keys, "__t", "left_anti")
        miss = miss.withColumns({"__windows": F.lit(None).cast(found.schema["__windows"].dataType), "__whole": F.lit(None).cast("boolean")})
        both = hit.unionByName(miss)
    else:
        both = tagged.join(found, "__t", "left")
    keep = [c for c in df.columns if c != text_col]
    schema = df.limit(0).select(
        *keep, F.lit(b"").alias("__kept"), *(F.lit(0).cast("long").alias(c) for c in ("__n_bytes", "__n_removed", "__n_spans"))
    ).schema

    def run(batches):
        n = len(keep)
        for batch in slices(batches, OUT_ROWS):
            windows = batch.column(n + 1)
            span = windows.offsets.to_numpy().tolist()
            first, last = (windows.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            kept, counts = [], []
            for i, whole in enumerate(batch.column(n + 2).to_pylist()):
                text, own = batch.column(n)[i].as_py(), slice(span[i], span[i + 1])
                left, runs = _cut(text, first[own], last[own], bool(whole), length, characters)
                kept.append(left)
                counts.append((len(text), len(text) - len(left), runs))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(kept, pa.binary()), *(pa.array(counts[:, i]) for i in range(3))],
                names=schema.names,
            )

    return both.select(*keep, "__text", "__windows", "__whole").mapInArrow(run, schema)


@guarded
def clean_texts(df: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``df`` with the repeats cut out of its texts. A character that loses some of its bytes
    goes; ``n_chars``, if there, counts the characters that are left; null texts stay null."""
    out = remove_repeats(df.withColumn("__null", F.col(text_col).isNull()), text_col, length, characters=True)
    out = out.withColumn(text_col, F.when(~F.col("__null"), F.col("__kept").cast("string")))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") == 0, F.col("n_chars")).otherwise(F.length(text_col).cast(df.schema["n_chars"].dataType)))
    return out.select(*df.columns)
