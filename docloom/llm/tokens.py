"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top 4 bits and, below, as many ids as fit at the selector's
width; the word with the most ids is taken each time. Ids of 2^60 and more follow an escape word
as they are. Ids are packed in blocks of BLOCK; the words of a block stand apart, and the table
of block offsets (and of escapes) lets numpy decode all words of a selector at once.

A file is a table of segments in ascending order of the documents' ids. A segment is a byte
string: header, the documents' ids and lengths, block offsets, escapes, words. Spark's writer
commits the segments, so a lost executor leaves no half file, and any store that Spark reaches
will do.

Words are encoded once in a worker and kept (up to CACHE_WORDS): a token never spans white space, nor
a letter and another character, so a text's ids are those of its parts.

Defined cases: a null text is empty and has the end id only; null ids come first; rows with equal
ids follow in the order they are read; an empty table gives no segments and no rows; a text longer than a
segment makes a segment of its own; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .sharding import ranged

BLOCK = 4096
SEGMENT_IDS = 1 << 18
END_ID = 2
CACHE_WORDS = 900_000
# The pattern by which the vocabulary splits words, for texts of plain characters: the
# first 256 without controls, no-break space and soft hyphen, whose normaliser but lower-cases.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^ \n{_LETTER}{_DIGIT}]+")
_PLAIN = bytes([10, *range(32, 127), *range(161, 173), *range(174, 256)])
_SIMPLE = b"\n .,abcdefghijklmnopqrstuvwxyz" + bytes([*range(0xDF, 0xF7), *range(0xF8, 0x100)])
# The steps of a file for which the above holds. Others encode each text in whole.
_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MAGIC = b"S8B1"
# (ids in a word, bits of each) by selector; selector 0 is the escape
SELECTORS = [(1, 64), *((n, 60 // n) for n in (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1))]
_HEADER = struct.Struct("<4sIQQII")  # magic, documents, ids, ids before, blocks, escapes


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each id takes."""
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(float))[1]
    return np.where(high != 0, 32 + np.frexp(high.astype(float))[1], low).astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each id the selector of the word that would start there: the most ids that fit."""
    n = len(bits)
    longest = SELECTORS[1][0]
    wide = np.zeros((-(-n // BLOCK), BLOCK + longest), np.uint8)  # what is past a block's end fits
    for b in range(len(wide)):
        part = bits[b * BLOCK : (b + 1) * BLOCK]
        wide[b, : len(part)] = part
    choice = np.zeros((len(wide), BLOCK), np.uint8)
    top, size = wide, 1  # the largest of the next ``size``
    for sel in range(len(SELECTORS) - 1, 0, -1):  # few ids first, more ids overwrite
        count, width = SELECTORS[sel]
        while size < count:
            step = min(size, count - size)
            top, size = np.maximum(top[:, :-step], top[:, step:]), size + step
        choice[top[:, :BLOCK] <= width] = sel
    return choice.ravel()[:n]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, places of escape words) of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    ends = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    choice = _choices(_bits(ids))
    step = np.array([c for c, _ in SELECTORS])[choice].tolist()
    picked, offsets = [], [0]
    escaped = choice == 0
    has_escape = bool(escaped.any())
    size = 0
    for begin in range(0, n, BLOCK):
        end, i, before = min(begin + BLOCK, n), begin, len(picked)
        while i < end:
            picked.append(i)
            i += step[i]
        size += len(picked) - before + (int(escaped[picked[before:]].sum()) if has_escape else 0)
        offsets.append(size)
    start = np.array(picked, np.int64)
    sel = choice[start] if n else choice
    place = np.arange(len(start)) + (np.cumsum(sel == 0) - (sel == 0))
    words = np.zeros(size, np.uint64)
    for s in np.unique(sel).tolist():
        count, width = SELECTORS[s]
        these = start[sel == s]
        if s == 0:
            words[place[sel == 0] + 1] = ids[these]
            continue
        where = these[:, None] + np.arange(count)
        inside = where < ends[these][:, None]
        value = np.where(inside, ids[np.minimum(where, n - 1)], np.uint64(0))
        shift = (np.arange(count) * width).astype(np.uint64)
        words[place[sel == s]] = np.bitwise_or.reduce(value << shift, axis=1) | np.uint64(s << 60)
    return words, np.array(offsets, np.uint32), place[sel == 0].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again."""
    raw = np.zeros(len(words), bool)
    raw[escapes.astype(np.int64) + 1] = True
    sel = (words >> np.uint64(60)).astype(np.int64)
    sel[escapes.astype(np.int64)] = 0
    counts = np.array([c for c, _ in SELECTORS] + [0])[sel]
    counts[raw] = 0
    upto = np.cumsum(counts)
    before = upto - counts
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    first = before[offsets[:-1].astype(np.int64)] if len(words) else before
    start = before - first[block] + block * BLOCK if len(words) else before
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    sel[raw] = -1
    for s in np.unique(sel).tolist():
        these = np.flatnonzero(sel == s)
        if s == 0:
            out[start[these]] = words[these + 1]
        elif s > 0:
            count, width = SELECTORS[s]
            shift = (np.arange(count) * width).astype(np.uint64)
            value = (words[these][:, None] >> shift) & np.uint64((1 << width) - 1)
            where = start[these][:, None] + np.arange(count)
            inside = where < end[these][:, None]
            out[where[inside]] = value[inside]
    return out


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    words, offsets, escapes = pack(ids)
    head = _HEADER.pack(MAGIC, len(doc_ids), len(ids), before, len(offsets) - 1, len(escapes))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    table = np.array([0 if x is None else x for x in doc_ids], "<i8")
    parts = [head, known.tobytes(), table.tobytes(), np.array(lengths, "<u8").tobytes()]
    parts += [offsets.astype("<u4").tobytes(), escapes.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
    return b"".join(parts)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(documents' ids, lengths, token ids, ids before it in its file)."""
    magic, docs, n, before, blocks, escapes = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    known, table, lengths = take("u1", docs), take("<i8", docs), take("<u8", docs)
    offsets, places = take("<u4", blocks + 1), take("<u4", escapes)
    words = take("<u8", int(offsets[-1]))
    ids = unpack(words.astype(np.uint64), offsets, places, n)
    return [int(x) if k else None for x, k in zip(table, known)], lengths.astype(np.int64), ids, before


_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer, the ids of words (None if it must see whole texts), and which ids end a token; kept
    while the worker lives."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        file = json.loads(tokenizer.to_str())
        found = {"normalizer": (file["normalizer"] or {}).get("normalizers"), "pre_tokenizer": (file["pre_tokenizer"] or {}).get("pretokenizers")}
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in file["added_tokens"])
        known = {} if found == _STEPS and special and file["model"].get("end_of_word_suffix") == "</w>" else None
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _TOKENIZERS[path] = tokenizer, known, ends
    return _TOKENIZERS[path]


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers, from one call."""
    tokenizer, _, ends = _tokenizer(path)
    text = " ".join(words)
    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    cut = np.flatnonzero(ends[ids]) + 1
    if len(cut) != len(words):  # a word of several tokens, or of none: cut where the words begin
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        first = np.fromiter((o[0] for o in offsets), np.int64, len(ids))
        cut = np.append(np.searchsorted(first, begin[1:]), len(ids))
    data, cut = ids.tobytes(), (4 * cut).tolist()
    return [data[a:b] for a, b in zip([0, *cut], cut)]


def _parts(text: str) -> list[str]:
    """A text as strings that the tokenizer encodes one by one: its tokens where only plain
    characters occur, else what stands between blanks."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = b"\0"
    if raw.translate(None, _PLAIN) or "<|" in text:
        return text.replace("\n", " ").split(" ")
    low = text.lower()
    if low.encode("latin-1").translate(None, _SIMPLE) or ".." in low or ".," in low or ",." in low or ",," in low:
        return _SPLIT.findall(low)
    return low.replace(".", " . ").replace(",", " , ").split()


def encode_texts(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Each text's ids and the end id as little-endian unsigned 32-bit integers."""
    tokenizer, known, _ = _tokenizer(path)
    if known is None:
        found = tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array([*x.ids, end_id], "<u4").tobytes() for x in found]
    if len(known) > CACHE_WORDS:
        known.clear()
    parts = [_parts(t or "") for t in texts]
    found = [list(map(known.get, p)) for p in parts]
    lacking = [None in f for f in found]
    new = list({w for p, f, x in zip(parts, found, lacking) if x for w, y in zip(p, f) if y is None})
    tokens, other = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
    for some in (tokens, other):
        for i in range(0, len(some), 5000):
            known.update(zip(some[i : i + 5000], encode_words(some[i : i + 5000], path)))
    tail = struct.pack("<I", end_id)
    get = known.__getitem__
    return [b"".join([*(map(get, p) if x else f), tail]) for p, f, x in zip(parts, found, lacking)]


def write_ids(df: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes every text of ``df`` and writes the segments to ``out``, ascending by ``id_col``."""

    def run(batches):
        part, no, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, held = [], [], 0

        def flush():
            nonlocal no, before, held
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
            data = segment(docs, [len(x) // 4 for x in ids], flat, before)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "segment", "n_ids", "data"],
            )
            no, before, held = no + 1, before + len(flat), 0
            ids.clear(), docs.clear()
            return row

        for batch in slices(batches, 200):
            keys, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for key, found in zip(keys, encode_texts(texts, tokenizer, end_id)):
                docs.append(key)
                ids.append(found)
                held += len(found) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    rows = ranged(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id"])
    rows.mapInArrow(run, "part int, segment int, n_ids long, data binary").write.parquet(out)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of each document in the files: ids is binary, little-endian
    unsigned 32-bit integers; start counts the ids of all documents before it. With ``digest``,
    ``ids_crc32`` (long) instead of the ids."""
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, lengths, ids, before = read_segment(batch.column(1)[i].as_py())
                flat = memoryview(ids.astype("<u4").tobytes())
                end = np.cumsum(lengths)
                start = end - lengths
                own = (flat[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist()))
                own = [zlib.crc32(x) for x in own] if digest else [bytes(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), batch.column(0)[i].as_py(), np.int32)),
                        pa.array(docs, pa.int64()),
                        pa.array(start + before),
                        pa.array(lengths),
                        pa.array(own, pa.int64() if digest else pa.binary()),
                    ],
                    names=["part", "id", "local", "n_tokens", last],
                )

    files = spark.read.schema("part int, segment int, n_ids long, data binary").parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    docs = files.select("part", "data").mapInArrow(run, f"part int, id long, local long, n_tokens long, {last} {kind}")
    # one row for each file, as many as the writer had partitions
    return docs.join(F.broadcast(starts), "part").select("id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", last)
