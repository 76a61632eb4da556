"""Vectors of texts: feature hashing, models behind a protocol."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

DIM = 384
KNOWN_TOKENS = 1 << 17


class Embedder(Protocol):
    """Anything that adds a vector to a table of texts. A neural model implements this with an
    iterator ``pandas_udf``, so that it is loaded once in a worker."""

    def embed(self, df: DataFrame, id_cols: list[str], text_col: str, out: str, query: bool = False) -> DataFrame: ...


class _Places(dict):
    """Tokens to the number of their place and sign: their md5 modulo 2 * DIM; forgets all when full."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        value = self[token] = int.from_bytes(hashlib.md5(token).digest()) % (2 * DIM)
        return value


class HashingEmbedder:
    """Each token adds or subtracts 1 at a place that its hash names; then unit length. Row by row in Arrow
    batches: no row moves."""

    dim = DIM

    def encoder(self) -> Callable[[pa.Array], np.ndarray]:
        """A function for one task, from texts in lower case to their vectors, a row each."""
        places = _Places()

        def encode(texts: pa.Array) -> np.ndarray:
            row, code, words = scan.coded(texts, False)
            place = np.array([places[w] for w in words], np.int64)
            signed = np.bincount(row * (2 * DIM) + place[code], minlength=len(texts) * 2 * DIM).reshape(-1, 2 * DIM)
            value = (signed[:, :DIM] - signed[:, DIM:]).astype(float)
            norm = np.sqrt((value * value).sum(1, keepdims=True))
            return value / np.where(norm == 0, 1, norm)

        return encode

    def embed(self, df: DataFrame, id_cols: list[str], text_col: str, out: str = "vector", query: bool = False) -> DataFrame:
        """``(ids..., out)``: texts without a token, and null ones, get the zero vector."""
        rows = df.select(*id_cols, F.lower(text_col).alias("__text"))
        schema = rows.drop("__text").withColumn(out, F.array(F.lit(0.0))).schema

        def run(batches):
            encode = self.encoder()
            for batch in batches:
                for at in range(0, batch.num_rows, scan.ROWS):
                    some = batch.slice(at, scan.ROWS)
                    offsets = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * DIM)
                    flat = pa.array(encode(some.column(some.num_columns - 1)).ravel())
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(offsets, flat)], names=schema.names)

        return rows.mapInArrow(run, schema)


def choose(name: str = "auto", neural: Embedder | None = None) -> Embedder:
    """The model if there is one and it is wanted, else hashing."""
    if name not in ("auto", "neural", "hashing"):
        raise ValueError(f"unknown embedder {name!r}")
    if name == "neural" and neural is None:
        raise ValueError("no neural embedder was given")
    return neural if neural is not None and name != "hashing" else HashingEmbedder()
