"""SentencePiece encoding by a max-plus scan, and decoding.

Of all ways to cut a text into pieces of the vocabulary the one with the greatest sum of scores
is wanted. Long texts are split into chunks of CHUNK characters. What a chunk has to know of its
left neighbour is how far before the boundary the last cut lies: REACH states at most, REACH
being the longest piece. A chunk yields a transfer matrix: the best sum from each state at its
start to each at its end. Max-plus products of matrices are associative, so prefix products give
the best sums at each boundary. Given those, a chunk tells from which state at its start each state
at its end is reached; these maps, applied from the last boundary back, fix the state at each. Then
every chunk backtraces on its own from the state that it is told. Scores are 64-bit integers (whole
ones as they are, others in steps of 2^-16), so the order in which they are added changes nothing.

A new word (a blank after another character) always starts a piece. Within a chunk the matrix is
the sum of a part before the first such cut and one after the last; the words between add the same to
every entry and are left out. Their pieces are found once in a worker and kept until another operator
uses the worker. A chunk without such a cut computes all states.

The vocabulary file marks its kind as merges by rank (BPE). Merging in order of rank is no sum of
scores and no scan computes it; as the method asks, pieces are chosen by their scores (in this file
the negative ranks), as the library's unigram encoder does with the same pieces. Ids therefore
can differ from the library's for this file, while decoding gives the same text. Characters
outside the vocabulary become byte pieces.

Of ways with equal sums the one whose last piece is longest is taken, from the end on.

Defined cases: a null or empty text has no ids; decoding gives back every text without U+2581,
which the vocabulary uses for the blank; rows are encoded one by one, whatever their ids, so repeated
rows come out alike; an empty table gives an empty one; columns named like an output are replaced,
others stay. A file that normalises texts, or has a piece that crosses the start of a word, is refused.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _KEPT, guarded, materialize, slices

CHUNK = 32768
BLANK = "▁"
CACHE_WORDS = 250_000
CACHE_PARTS = 700_000
LOW = -(1 << 60)
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class _Words(dict):
    """A word to the ids of it with a blank before; forgets all when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.vocabulary.unit(BLANK + word)
        return found


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "a  b\u3000\uff21\u0301\t\n "
        if model.normalize(probe) != normal(probe):
            raise ValueError(f"{path}: texts are taken as they are, with a blank before, but this file normalises them")
        scores = [model.get_score(i) for i in range(model.vocab_size())]
        steps = 1 if all(x == int(x) for x in scores) else 1 << 16
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.pieces[piece] = (i, round(scores[i] * steps))
                self.text.append(piece.replace(BLANK, " ").encode())
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces):
            raise ValueError(f"{path}: a piece crosses the start of a word")
        self.reach = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10 * steps
        # each start of a piece: its score, or None if it is no piece itself
        self.starts: dict[str, int | None] = {p[:n]: None for p in self.pieces for n in range(1, len(p))}
        self.starts |= {p: s for p, (_, s) in self.pieces.items()}
        self.inner = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.units: dict[str, bytes] = {}
        self.words = _Words(self)

    def best(self, s: str, begin: dict[int, int], first_end: int) -> tuple[list[int], list[int]]:
        """Best sums and last cuts for each place of ``s``. begin: the places where pieces may
        start at first, with their sums; a piece from such a place ends at ``first_end`` or later,
        other places start pieces from ``first_end`` on."""
        n = len(s)
        score, back = [LOW] * (n + 1), [-1] * (n + 1)
        get = self.starts.get
        for a in sorted({*begin, *range(first_end, n)}):
            base = begin.get(a, LOW)
            if a >= first_end and score[a] > base:
                base = score[a]
            if base == LOW or a >= n:
                continue
            single = False
            for b in range(a + 1, n + 1):
                x = get(s[a:b], False)
                if x is False:
                    break
                if x is not None:
                    if b == a + 1:
                        single = True
                    if b >= first_end and base + x > score[b]:
                        score[b], back[b] = base + x, a
            if not single and a + 1 >= first_end and base + self.unknown > score[a + 1]:
                score[a + 1], back[a + 1] = base + self.unknown, a
        for a, x in begin.items():
            if a >= first_end and x >= score[a]:
                score[a], back[a] = x, -1
        return score, back

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [found[0]] if found else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def trace(self, s: str, back: list[int], end: int, stop: int) -> list[int]:
        """Ids of the pieces from ``stop`` to ``end``."""
        cuts = [end]
        while cuts[-1] > stop:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.ids_of(s[a:b])]

    def unit(self, s: str) -> bytes:
        """Ids (little-endian unsigned 32-bit) of a string that starts and ends with a cut.
        Neighbours that no piece has in it are cut apart first: many words share such parts."""
        inner, known, at = self.inner, self.units, 0
        parts = []
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i - 1 : i + 1] not in inner:
                part = s[at:i]
                parts.append(known.get(part) or self._solve(part))
                at = i
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def _solve(self, s: str) -> bytes:
        if len(self.units) >= CACHE_PARTS:
            self.units.clear()
        _, back = self.best(s, {0: 0}, 0)
        ids = self.trace(s, back, len(s), 0)
        found = self.units[s] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def run(self, s: str) -> bytes:
        """Ids of a normal text that starts with a blank or is empty."""
        if not s:
            return b""
        if s[0] != BLANK or BLANK + BLANK in s:
            return b"".join(map(self.unit, units(s)))
        return b"".join(map(self.words.__getitem__, s[1:].split(BLANK)))

    def encode(self, text: str | None) -> bytes:
        return self.run(normal(text)) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.text.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    _KEPT["pieces"] = _LOADED.clear
    return _LOADED[path]


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def units(s: str) -> list[str]:
    """Runs of blanks with what follows them; only the first may be without blank."""
    return _UNIT.findall(s)


# --- chunks ------------------------------------------------------------------------------


def cuts_in(s: str, after: int) -> list[int]:
    """Places of ``s`` beyond ``after`` where a word starts: each is a cut of every way."""
    at = [m.start() for m in re.finditer(f"(?<=[^{BLANK}]){BLANK}", s[max(0, after - 1) :])]
    return [a + max(0, after - 1) for a in at if a + max(0, after - 1) > after]


class Chunk:
    """Ways through a chunk. ``s`` has ``left`` characters before the chunk's start. ``begin`` holds
    the places up to ``left`` where its first piece may start, with their sums."""

    def __init__(self, v: Vocabulary, s: str, left: int):
        self.v, self.s, self.left, self.n = v, s, left, len(s)
        self.low = max(self.n - v.reach + 1, left + 1)
        forced = cuts_in(s, left)
        self.f, self.last = (forced[0], forced[-1]) if forced else (self.n, None)
        if forced:
            self.tail, self.tail_back = v.best(s[self.last :], {0: 0}, 0)
            self.low = max(self.low, self.last)

    def head(self, begin: dict[int, int]) -> tuple[list[int], list[int]]:
        """Up to the first place where a word starts, or the chunk's end."""
        return self.v.best(self.s[: self.f], begin, self.left + 1)

    def sums(self, begin: dict[int, int]) -> dict[int, int]:
        """The best sum to each place at the end that can be a state. What lies between the first
        and the last start of a word is left out: it adds the same to all of them."""
        score, _ = self.head(begin)
        if self.last is None:
            return {e: score[e] for e in range(self.low, self.n + 1) if score[e] > LOW}
        if score[self.f] <= LOW:
            return {}
        base = score[self.f]
        return {e: base + self.tail[e - self.last] for e in range(self.low, self.n + 1) if self.tail[e - self.last] > LOW}

    def _cuts(self, back: list[int], end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > self.left:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]

    def entries(self, begin: dict[int, int]) -> list[int]:
        """For each state at the end the state at the start that the best way comes from."""
        score, back = self.head(begin)
        if self.last is not None:
            return [self.left - self._cuts(back, self.f)[0]] * self.v.reach
        ends = (self.n - j for j in range(self.v.reach))
        return [self.left - self._cuts(back, e)[0] if e >= self.low and score[e] > LOW else 0 for e in ends]

    def ids(self, begin: dict[int, int], end: int) -> bytes:
        _, back = self.head(begin)
        cuts = self._cuts(back, end if self.last is None else self.f)
        first = [i for x, y in zip(cuts, cuts[1:]) for i in self.v.ids_of(self.s[x:y])]
        out = [struct.pack(f"<{len(first)}I", *first)]
        if self.last is not None:
            final = self.v.trace(self.s[self.last :], self.tail_back, end - self.last, 0)
            out += [self.v.run(self.s[self.f : self.last]), struct.pack(f"<{len(final)}I", *final)]
        return b"".join(out)

    def matrix(self) -> np.ndarray:
        """Entry (i, j): the best sum from a cut i characters before the chunk's start to one j
        characters before its end, both the last at or before their boundaries."""
        m = self.v.reach
        out = np.full((m, m), LOW, np.int64)
        for i in range(min(m, self.left + 1)):
            for e, x in self.sums({self.left - i: 0}).items():
                if self.n - e < m:
                    out[i, self.n - e] = x
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(-2), LOW)


def prefix_products(stack: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by pairs: log-depth, as the scan combines them."""
    if len(stack) == 1:
        return stack
    pairs = product(stack[0 : len(stack) // 2 * 2 : 2], stack[1::2])
    done = prefix_products(pairs)
    out = np.empty_like(stack)
    out[0] = stack[0]
    out[1::2] = done
    if len(stack) > 2:
        out[2::2] = product(done[: len(out[2::2])], stack[2::2])
    return out


def at_boundaries(stack: np.ndarray) -> np.ndarray:
    """The best sum to each state at the start of each chunk, from the text's start."""
    out = np.full((len(stack), stack.shape[-1]), LOW, np.int64)
    out[0, 0] = 0
    out[1:] = prefix_products(stack)[:-1, 0, :]
    return out


def _begin(left: int, sums: list[int]) -> dict[int, int]:
    return {left - j: x for j, x in enumerate(sums) if x > LOW}


@guarded
def encode_texts(df: DataFrame, model: str, text_col: str = "text", chunk: int = CHUNK, decode: bool = False) -> DataFrame:
    """The columns of ``df`` plus ``__ids``, binary, little-endian unsigned 32-bit ids; with
    ``decode`` also what ``decode_ids`` adds, from the same pass over short texts."""
    keep = df.columns
    schema = df.limit(0).withColumn("__ids", F.lit(b"")).schema
    full = _with_decoded(df.limit(0).withColumn("__ids", F.lit(b""))).schema if decode else schema
    short = df.filter(F.coalesce(F.length(text_col), F.lit(0)) <= chunk)
    long_ = df.filter(F.length(text_col) > chunk)

    def whole(batches):
        v = vocabulary(model)
        for batch in slices(batches, 200, "pieces"):
            ids = [v.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            more = _decoded(v, ids) if decode else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), *more], names=full.names)

    def split(batches):
        reach = vocabulary(model).reach
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = normal(text)
                for no, a in enumerate(range(0, len(s), chunk)):
                    left = min(a, reach - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([no], pa.int32()), pa.array([left], pa.int32()), pa.array([s[a - left : a + chunk]])],
                        names=["t", "no", "before", "s"],
                    )

    def matrices(batches):
        v = vocabulary(model)
        for batch in slices(batches, 50, "pieces"):
            flat = [Chunk(v, s, left).matrix().ravel() for left, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64()))], names=["t", "no", "m"])

    def scan(batches):
        reach = vocabulary(model).reach
        for batch in batches:
            for key, stack in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = stack.values.field(1).flatten().to_numpy(zero_copy_only=False)
                sums = at_boundaries(flat.reshape(-1, reach, reach))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                    names=["t", "no", "sums"],
                )

    def enter(batches):
        v = vocabulary(model)
        for batch in slices(batches, 50, "pieces"):
            _, _, left, s, sums = (x.to_pylist() for x in batch.columns)
            found = [Chunk(v, x, n).entries(_begin(n, begin)) for x, n, begin in zip(s, left, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["t", "no", "came"])

    def backtrace(batches):
        v = vocabulary(model)
        for batch in slices(batches, 50, "pieces"):
            _, _, left, s, sums, leave = (x.to_pylist() for x in batch.columns)
            ids = [Chunk(v, x, n).ids(_begin(n, begin), len(x) - end) for x, n, begin, end in zip(s, left, sums, leave)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["t", "no", "ids"])

    done = short.select(*keep, F.col(text_col).alias("__text")).mapInArrow(whole, full)
    # equal long texts are scanned once; a text's chunks are dealt to all executors
    tagged = long_.withColumn("__t", F.sha2(F.col(text_col).cast("binary"), 256))
    texts = tagged.groupBy(F.col("__t").alias("t")).agg(F.first(text_col).alias("text"))
    chunks = texts.mapInArrow(split, "t string, no int, before int, s string").repartition("t", "no")
    chunks = materialize(chunks, "piece-chunks")
    found = chunks.mapInArrow(matrices, "t string, no int, m array<bigint>")
    # a text's matrices take a hundredth of the memory of its chunks, so one task can hold them
    stacks = found.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("no", "m"))).alias("stack"))
    sums = stacks.mapInArrow(scan, "t string, no int, sums array<bigint>")
    chunks = materialize(chunks.join(sums, ["t", "no"]).select("t", "no", "before", "s", "sums"), "piece-sums")
    came = chunks.mapInArrow(enter, "t string, no int, came array<int>")

    def leaves(batches):
        """From the last boundary, state 0, each chunk tells the state at the boundary before."""
        for batch in batches:
            for key, stack in zip(batch.column(0).to_pylist(), batch.column(1)):
                states, out = stack.values.field(1), [0]
                for i in range(len(states) - 1, 0, -1):
                    out.append(states[i][out[-1]].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(out)), pa.array(range(len(out)), pa.int32()), pa.array(out[::-1], pa.int32())], names=["t", "no", "leave"]
                )

    def joins(batches):
        for batch in batches:
            for key, stack in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = b"".join(x.as_py() for x in stack.values.field(1))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([whole], pa.binary())], names=["t", "__ids"])

    listed = lambda df, c: df.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("no", c))).alias("all"))
    leave = listed(came, "came").mapInArrow(leaves, "t string, no int, leave int")
    traced = chunks.join(leave, ["t", "no"]).select("t", "no", "before", "s", "sums", "leave")
    parts = traced.mapInArrow(backtrace, "t string, no int, ids binary")
    joined = listed(parts, "ids").mapInArrow(joins, "t string, __ids binary").withColumnRenamed("t", "__t")
    rest = tagged.join(joined, "__t").select(*keep, "__ids")
    return done.unionByName(decode_ids(rest, model) if decode else rest)


def _with_decoded(df: DataFrame) -> DataFrame:
    return df.withColumns({"__decoded": F.lit(""), "__ids_crc32": F.lit(0).cast("long")})


def _decoded(v: Vocabulary, ids: list[bytes]) -> list[pa.Array]:
    texts = [v.decode(np.frombuffer(x, "<u4")) for x in ids]
    return [pa.array(texts, pa.string()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]


def decode_ids(df: DataFrame, model: str, ids_col: str = "__ids") -> DataFrame:
    """The columns of ``df`` plus ``__decoded`` and ``__ids_crc32`` (long)."""
    schema = _with_decoded(df.limit(0)).schema

    def run(batches):
        v = vocabulary(model)
        for batch in slices(batches, 200, "pieces"):
            ids = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_decoded(v, ids)], names=schema.names)

    return df.select("*", F.col(ids_col).alias("__copy")).mapInArrow(run, schema)
