"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles.
Equal fingerprints are one node. Two widths are in use:

* 64 bits and a small distance (``link_fingerprints``): the 64 bits are split into
  ``max_bits + 2`` blocks; fingerprints at that distance or less agree in two blocks at least,
  so they share one of the keys made of two blocks. No pair is missed.
* 256 bits and a large distance (``near_copies``): similarity 0.8 of five-word shingles means
  some 39 of 256 bits, for which disjoint blocks are no filter. The blocks are then fixed
  pseudo-random choices of 24 of the 256 bits, and the nearest of those that share one is
  verified exactly, by the Jaccard similarity of their shingles. As such blocks miss pairs, an
  exact join on the rarest shingles finds the rest. No pair is missed.

Defined cases: a null text counts as empty; a text without words has the fingerprint zero; a
text with fewer words than a shingle is one shingle; null ids never become a component's id
unless the whole component has no other; repeated rows each come back, in one component; very long
texts are hashed in whole, STEP shingles at a time; an empty table gives an empty one; other columns are
not read by ``simhash_components`` and are kept as they are by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, guarded, materialize, release, slices, text_bytes, text_key

SEED = 42
STEP = 1 << 16  # shingles of one text that are hashed at a time


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at the bytes 0x20 and 0x09-0x0D, as bytes.split() does."""
    return text.lower().split()


def shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    if not words:
        return
    if len(words) <= k:
        yield b" ".join(words)
        return
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    for a, b in zip(begin[: len(words) - k + 1].tolist(), (begin + size - 1)[k - 1 :].tolist()):
        yield line[a:b]


def fingerprint(text: bytes, k: int) -> bytes:
    """64 bits, the highest bit first."""
    votes, n, part = np.zeros(64, np.int64), 0, []

    def count() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        votes[:] += bits.sum(0, dtype=np.int64)

    digest = xxhash.xxh64_digest
    for s in shingles(words_of(text), k):
        part.append(digest(s, SEED))
        n += 1
        if len(part) == STEP:
            count()
            part.clear()
    if part:
        count()
    return np.packbits(2 * votes > n).tobytes()


class _Known(dict):
    """The hashes of words that a task has met, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def token_hashes(text: bytes, k: int, known: _Known) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending, each made of the hashes of its words;
    one for a text without words."""
    words = words_of(text)
    if not words:
        return np.zeros(1, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(each))
    n = len(each) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return np.unique(_mixed_bits(out))


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES signed longs; a bit is 1 if it is set for over half of the hashes."""
    votes = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(_mixed_bits(part).view(np.uint8), axis=1)
        for low in range(0, len(bits), 255):  # as many as a byte can count
            votes += bits[low : low + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """SKETCH longs, whose bit i tells whether the number of ``hashes`` that fall to i is odd. Sketches of
    two sets differ in no more bits than there are hashes in only one of them."""
    bits = 64 * SKETCH
    found = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(found.astype(np.uint8)).view(np.int64)


def prefix(hashes: np.ndarray, least: float, classes: np.ndarray) -> np.ndarray:
    """The first of ``hashes`` in the order of their class, then value. Two sets with a Jaccard
    similarity of ``least`` or more have one in common."""
    order = np.argsort(classes[hashes >> np.uint64(64 - CLASS_BITS)], kind="stable")
    return hashes[order[: len(hashes) - math.ceil(least * len(hashes) - EPSILON) + 1]]


def with_fingerprint(df: DataFrame, text: Column, keep: list[str], k: int) -> DataFrame:
    """``keep`` columns plus ``fp``, a signed long. ``text`` is binary."""
    schema = df.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in slices(batches, 1000):
            n = batch.num_columns - 1
            flat = b"".join(fingerprint(t or b"", k) for t in batch.column(n).to_pylist())
            values = pa.array(np.frombuffer(flat, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], values], names=schema.names)

    return df.select(*keep, text.alias("__text")).mapInArrow(run, schema)


def link_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fps(fp long)``, distinct, to all pairs ``(a, b)``, a < b, at ``max_bits`` bits or fewer."""
    n = max_bits + 2
    edge = [round(i * 64 / n) for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [
        F.struct(F.lit(i).cast("tinyint").alias("i"), F.col("fp").bitwiseAND(F.lit(signed(x | y))).alias("k"))
        for i, (x, y) in enumerate(combinations(masks, 2))
    ]
    blocks = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.i", "key.k")
    a, b = blocks.alias("a"), blocks.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.i") == F.col("b.i"))
    pairs = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & near)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(id, fp, component_id)``, a row for each row of ``df``; ``fp`` as a long."""
    rows = with_fingerprint(
        df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")), F.col("t"), ["id"], k
    )
    rows = materialize(rows, "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp"), max_bits))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("id", "fp", "component_id")


# --- five-word shingles at similarity 0.8 -------------------------------------------------

LANES = 4
BLOCK_BITS = 24
BLOCKS = 48
CLASS_BITS = 20
SKETCH = 4  # longs of a text's parities
KNOWN_WORDS = 1 << 17  # words whose hashes a task keeps at a time
SAMPLE = 8  # one text in so many counts for the classes
OFTEN = 3  # a shingle found in so many texts of the sample is no longer of class 0
SPLIT = 1000  # rows of one shingle that meet all its other rows in one task
ROUNDS = 1  # in which texts meet some others before all do
NEAREST = 2  # pairs of a text that a round verifies
EPSILON = 1e-9
BROADCAST_GONE = 200_000  # rows to leave out are sent to all executors up to this many, joined beyond
BROADCAST_IDS = 200_000  # ids are sent to all executors up to this many, joined beyond


def block_keys(bits: np.ndarray) -> np.ndarray:
    """(n, 256) bits to (n, BLOCKS) block values; each block is a fixed choice of bits."""
    rng = random.Random(SEED)
    out = np.empty((len(bits), BLOCKS), np.int64)
    weight = 1 << np.arange(BLOCK_BITS, dtype=np.int64)
    for i in range(BLOCKS):
        out[:, i] = bits[:, rng.sample(range(64 * LANES), BLOCK_BITS)] @ weight + (i << BLOCK_BITS)
    return out


def _spread(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            flat = some.column(1).flatten().to_numpy(zero_copy_only=False)
            bits = np.unpackbits(flat.astype(">i8").view(np.uint8).reshape(-1, 8 * LANES), axis=1)
            keys = np.repeat(some.column(0).to_numpy(zero_copy_only=False), BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_keys(bits.astype(np.int64)).ravel()), pa.array(keys)], names=["block", "node"]
            )


def jaccard(a: bytes, b: bytes, k: int) -> float:
    x, y = set(shingles(words_of(a), k)), set(shingles(words_of(b), k))
    return len(x & y) / len(x | y) if x or y else 1.0


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose texts' shingles have a Jaccard similarity of ``least``
    or more. ``nodes(node, key)``; ``texts(key, text)``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    asked = materialize(asked, "near-keys")
    keys = asked.select("key")
    if asked.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    some = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    some = materialize(some.join(asked, "key").select("node", "text"), "near-texts")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )
    names = pairs.columns

    def run(batches):
        known = _Known()

        def near(x: bytes, y: bytes) -> bool:
            a, b = token_hashes(x, k, known), token_hashes(y, k, known)
            common = len(np.intersect1d(a, b, assume_unique=True))
            return common >= least * (len(a) + len(b) - common) - EPSILON and jaccard(x, y, k) >= least

        for batch in slices(batches, 200):
            texts = zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())
            good = pa.array([near(x, y) for x, y in texts], pa.bool_())
            yield batch.select(names).filter(good)

    found = materialize(both.select(*names, "ta", "tb").mapInArrow(run, pairs.schema), "near-sure")
    release(pairs, asked, some)
    return found


def _close(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b, ...)`` with ``d``, the differing bits of their fingerprints."""
    both = pairs.join(fps.select(F.col("node").alias("a"), F.col("fp").alias("fa")), "a").join(
        fps.select(F.col("node").alias("b"), F.col("fp").alias("fb")), "b"
    )
    bits = [F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(LANES)]
    return both.select(*pairs.columns, sum(bits[1:], bits[0]).alias("d"))


def _classes(texts: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur, as powers of two in a sample, by the first bits of their hashes. It
    only sets the order that ``prefix`` takes: frequent shingles come last. The table has
    2^CLASS_BITS places at any size of the input."""

    def run(batches):
        known = _Known()
        for batch in slices(batches, 200):
            found = np.concatenate([token_hashes(t, k, known) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["token"])

    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "token long")
    often = some.groupBy("token").count().filter(F.col("count") >= OFTEN)
    slot = F.shiftrightunsigned("token", 64 - CLASS_BITS).cast("int")
    table = often.groupBy(slot.alias("slot")).agg(F.max(F.ceil(F.log2("count"))).cast("int").alias("class")).toPandas()
    out = np.zeros(1 << CLASS_BITS, np.uint8)
    out[table["slot"].to_numpy(np.int64)] = table["class"].to_numpy(np.uint8)
    return out


def _possible(a: str, b: str, least: float) -> Column:
    """False for rows ``a`` and ``b`` of one shingle whose texts can't have it as their first in common
    and a similarity of ``least``, by their numbers of shingles and its places."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    common = F.least(x - F.col(f"{a}.pos"), y - F.col(f"{b}.pos"))
    return (F.least(x, y) >= least * F.greatest(x, y) - EPSILON) & ((1 + least) * common >= least * (x + y) - EPSILON)


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of shingles that texts of different components share. The shingles' facts are written before
    the join, so that Spark splits a frequent one."""
    facts = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    facts = materialize(facts.filter("lo <> hi").select("token"), "near-shared")
    return materialize(rows.join(facts, "token"), "near-tokens")


def _to_heads(mixed: DataFrame, fps: DataFrame, least: float, no: int) -> DataFrame:
    """For each text the NEAREST of some texts of other components that share a shingle with it, one of each
    shingle and others in each round ``no``. As many pairs at most as NEAREST times the texts."""
    order = F.struct(F.xxhash64("node", F.lit(no)), "node")
    heads = mixed.groupBy("token").agg(F.min_by(F.struct("node", "root", "size", "pos"), order).alias("h"))
    a = mixed.join(materialize(heads, "near-heads"), "token").alias("a")
    met = a.filter((F.col("root") != F.col("h.root")) & _possible("a", "h", least))
    met = met.select(F.col("a.node").alias("a"), F.col("h.node").alias("b"), F.col("a.root").alias("ra"), F.col("h.root").alias("rb")).distinct()
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "b", "rb"))), 1, NEAREST)
    near = _close(met, fps).groupBy("a", "ra").agg(best.alias("best"))
    return near.select("a", F.explode("best").alias("x"), "ra").select("a", "x.b", "ra", "x.rb")


def _few_apart(a: str, b: str, least: float) -> Column:
    """False for rows whose ``sketch`` shows more shingles in only one of the texts than a similarity of
    ``least`` leaves room for."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    bits = [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH)]
    return (1 + least) * sum(bits[1:], bits[0]) <= (1 - least) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + EPSILON


def _all_pairs(mixed: DataFrame, least: float, sketches: DataFrame | None = None) -> DataFrame:
    """All pairs of different components that share a shingle of their prefixes, but for those that
    ``sketches(node, sketch)``, if given, prove to be below ``least``.

    Of each shingle, the rows outside its largest component meet all rows of other components. The
    rows that they meet are dealt to parts of SPLIT rows, so a frequent shingle spans many tasks."""
    counts = mixed.groupBy("token", "root").count()
    facts = counts.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.sum("count").alias("n"))
    rows = mixed.select("token", "root", "node", "size", "pos").join(materialize(facts, "near-big"), "token")
    if sketches is not None:
        rows = materialize(rows.join(sketches, "node"), "near-rows")
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    a = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("a")
    b = rows.filter("root <> big").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("b")
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part"))
    once = (F.col("a.root") == F.col("a.big")) | (F.col("a.root") < F.col("b.root"))
    may = once & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", least)
    if sketches is not None:
        may = may & _few_apart("a", "b", least)
    pairs = a.join(b, same & may)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.root").alias("ra"), F.col("b.root").alias("rb")).distinct()


def near_copies(df: DataFrame, text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(key, root)`` for each distinct text, key being its ``text_key``: texts of one root are
    equal or linked by pairs of ``similarity`` or more.

    SimHash blocks link each text to the nearest of the most central members of its blocks, at most
    one pair a text, which keeps large groups from becoming all their pairs. What that leaves in
    different components is found by an exact prefix-filter join: texts of ``similarity`` share one
    of the rarest shingles, a fifth of each text's. First each text meets some others, so that large
    groups become few components, then all that are still apart do, unless the parities of their
    shingles' hashes already tell that they differ too much.
    """
    texts = df.select(text_key(text_col).alias("key"), text_bytes(text_col).alias("text"))
    classes = _classes(texts, k)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

    def marked(batches):
        known = _Known()
        for batch in slices(batches, 200):
            hashes = [token_hashes(t, k, known) for t in batch.column(1).to_pylist()]
            fp = lists([wide_fingerprint(h) for h in hashes])
            tokens = lists([prefix(h, similarity, classes).view(np.int64) for h in hashes])
            sketch = lists([parities(h) for h in hashes])
            size = pa.array(list(map(len, hashes)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fp, sketch, size, tokens], names=["key", "fp", "sketch", "size", "tokens"]
            )

    fps = texts.mapInArrow(marked, "key binary, fp array<long>, sketch array<long>, size int, tokens array<long>")
    fps = fps.groupBy("key").agg(*(F.first(c).alias(c) for c in ("fp", "sketch", "size", "tokens")))
    # a short name for each text, fixed by being written
    fps = materialize(fps.withColumn("node", F.monotonically_increasing_id()), "near-fp")
    blocks = materialize(fps.select("node", "fp").mapInArrow(_spread, "block long, node long"), "near-blocks")
    full = materialize(blocks.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"), "near-full")
    every, blocks = blocks, materialize(blocks.join(full, "block"), "near-shared-blocks")
    release(every, full)
    # the text that others were copied from shares blocks with more texts than they do
    reach = materialize(blocks.groupBy("node").agg(F.sum("n").alias("reach")), "near-reach")
    placed_blocks = blocks.join(reach, "node")
    heads = placed_blocks.groupBy("block").agg(F.max(F.struct("reach", "node")).alias("h"))
    heads = materialize(heads.select("block", F.col("h.node").alias("head")), "near-heads")
    star = blocks.join(heads, "block").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    star = _close(star, fps).groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    sure = _verified(materialize(star, "near-star"), fps, texts, k, similarity)
    release(blocks, reach, heads)

    def replaced(rows: DataFrame, roots: DataFrame) -> DataFrame:
        new = roots.select(F.col("node").alias("root"), F.col("root").alias("__root"))
        return rows.join(new, "root", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root")

    placed = materialize(replaced(fps.select("node", F.col("node").alias("root")), connected_components(sure)), "near-placed")
    tokens = fps.join(placed, "node").select("node", "root", "size", F.posexplode("tokens").alias("pos", "token"))
    mixed = _mixed(tokens)
    for no in range(ROUNDS + 1):
        pairs = _to_heads(mixed, fps, similarity, no) if no < ROUNDS else _all_pairs(mixed, similarity, fps.select("node", "sketch"))
        cross = _verified(materialize(pairs, "near-cross"), fps, texts, k, similarity)
        roots = connected_components(cross.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        placed = replaced(placed, roots)
        if no < ROUNDS:
            old, mixed = mixed, _mixed(replaced(mixed, roots))
            release(old)
    return fps.select("node", "key").join(placed, "node").select("key", "root")


@guarded
def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row with the smallest id stays
    (null ids come last; of rows equal in id and text one stays). Columns are those of ``df``."""
    light = df.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    per_text = light.groupBy("key").agg(F.min("id").alias("id"))
    best = (
        per_text.join(near_copies(df, text_col, k, similarity), "key")
        .groupBy("root")
        .agg(F.min_by(F.struct("id", "key"), order).alias("best"))
        .select(F.col("best.id").alias("__i"), F.col("best.key").alias("__k"))
    )
    same = (F.col("key") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__i"))
    gone = light.distinct().join(materialize(best, "near-best"), same, "left_anti")
    gone = materialize(gone.select(F.col("key").alias("__k"), F.col("id").alias("__i")), "near-gone")
    if gone.count() <= BROADCAST_GONE:  # texts then need not move
        gone = F.broadcast(gone)
    tagged = df.withColumns({"__key": text_key(text_col), "__id": F.col(id_col)})
    kept = tagged.join(gone, (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")), "left_anti")
    if not light.groupBy("key", "id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__key", "__id"])
    return kept.select(*df.columns)
