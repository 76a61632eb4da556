"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. A sentence is toxic with
probability p = sigmoid(bias + the weights of its words' features); the document's score is their
noisy-or, 1 - prod(1 - p). Bias and weights are trained on that score by gradient descent, so
blame goes to the sentences that explain the labels, and those can be named afterwards.

A word's features are its first 3 to 6 letters and the word itself. Features that are frequent
enough and tell the classes apart are kept.

``max_rows`` (TRAIN_ROWS) bounds the labelled rows that training sees, those with the smallest hash of
the id, and ``max_chars`` (TRAIN_CHARS) their characters in sum, so what the driver fits on is bounded. Ids
whose texts have more than ``row_chars`` (TRAIN_ROW_CHARS) characters are not learned from; the others are;
``max_features`` (MAX_FEATURES) and ``min_chi`` (MIN_CHI) bound the model. Scoring reads every text in whole.

Defined cases: a null or empty text has no sentence with a word and scores 0; null ids are not
held out and never trained on; labels with a null id or value are ignored; of several labels of an
id the largest counts; repeated rows score alike; without any usable label all scores are 0; a very
long text is scored in whole, sentence by sentence; an empty table gives an empty one; columns named like
an output are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, materialize, slices

TRAIN_ROWS = 12_000
TRAIN_CHARS = 60_000_000
TRAIN_ROW_CHARS = 1_000_000
MAX_FEATURES = 20_000
MIN_DOCS = 5
MIN_CHI = 30.0
THRESHOLD = 0.3
CACHE_WORDS = 200_000

_SENTENCE = re.compile(r"[.!?\n]+")
_PART = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split((text or "").lower()) if not s.isspace() and s]


def features(word: str) -> list[str]:
    """Of a lower-case word, as split at white space."""
    out = []
    for part in _PART.findall(word):
        out.append("=" + part)
        out.extend(part[:n] for n in range(3, 7) if len(part) >= n)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)


class _Words(dict):
    """Word to the sum of its features' weights; forgets all when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.weights.get
        value = self[word] = sum([get(f, 0.0) for f in features(word)])
        return value


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(bag_sizes, sentence_sizes, col, labels, n_features: int, steps: int = 400, rate: float = 0.15, l2: float = 2e-6):
    """Weights and bias of the noisy-or by Adam. bag_sizes: sentences of each document;
    sentence_sizes: features of each sentence; col: the features' numbers."""
    n_bags, n_flat = len(bag_sizes), len(sentence_sizes)
    doc = np.repeat(np.arange(n_bags), bag_sizes)
    row = np.repeat(np.arange(n_flat), sentence_sizes)
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = labels.astype(float)
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[col], n_flat) + theta[-1]
        p = _sigmoid(z)
        log_clean = np.bincount(doc, -np.logaddexp(0, z), n_bags)  # log of prod(1 - p)
        score = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for clean documents, p - p / score for toxic ones
        grad_z = p * (1 - y[doc] / score[doc]) / max(1, n_bags)
        grad = np.append(np.bincount(col, grad_z[row], n_features), grad_z.sum()) + l2 * np.append(theta[:-1], 0)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = TRAIN_ROWS,
    max_chars: int = TRAIN_CHARS,
    row_chars: int = TRAIN_ROW_CHARS,
    max_features: int = MAX_FEATURES,
    min_chi: float = MIN_CHI,
) -> Model:
    """Learns from labelled rows of ``docs`` that are not held out, ``max_rows`` of them at most."""
    rows = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col) > 0).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    spark = docs.sparkSession
    picked = spark.createDataFrame(rows.collect(), rows.schema)  # max_rows bounds it
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    # found once; the rows of an id come together, max_rows bounds the ids in the window
    texts = materialize(texts.repartition(spark.sparkContext.defaultParallelism), "toxic-labelled")
    sizes = texts.groupBy("id").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n"))
    sizes = sizes.filter(F.col("n") <= min(row_chars, max_chars))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))
    within = sizes.withColumn("upto", upto).filter(F.col("upto") <= max_chars).select("id")
    texts = texts.join(F.broadcast(within), "id", "left_semi")

    def seen(batches):
        for batch in slices(batches, 500):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for s in sentences(text) for w in s.split()}
                found = sorted({f for w in words for f in features(w)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([int(y)] * len(found), pa.int64())], names=["f", "y"]
                )

    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("toxic")).first()
    n, toxic = total.n, total.toxic
    if not toxic or toxic == n:
        return Model(bias=-60.0 if not toxic else 0.0)
    share = toxic / n
    kept = (
        texts.select("text", "y")
        .mapInArrow(seen, "f string, y long")
        .groupBy("f")
        .agg(F.count("*").alias("d"), F.sum("y").alias("k"))
        .filter(F.col("d") >= MIN_DOCS)
        .withColumn("chi", (F.col("k") - F.col("d") * share) ** 2 / (F.col("d") * share * (1 - share)))
        .filter(F.col("chi") > min_chi)
        .orderBy(F.desc("chi"), "f")
        .limit(max_features)
        .select("f")
    )
    number = {r.f: i for i, r in enumerate(kept.collect())}

    def bags(batches):
        for batch in slices(batches, 500):
            sizes, flat = [], []
            for text in batch.column(0).to_pylist():
                bag = [[number[f] for w in s.split() for f in features(w) if f in number] for s in sentences(text)]
                sizes.append([len(s) for s in bag])
                flat.append([f for s in bag for f in s])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, kind), pa.array(flat, kind), batch.column(1)], names=["sizes", "flat", "y"])

    if not number:
        return Model(bias=float(np.log(share / (1 - share))))
    got = texts.select("text", "y").mapInArrow(bags, "sizes array<int>, flat array<int>, y boolean").toArrow()
    sizes, flat = (got.column(i).combine_chunks() for i in (0, 1))
    weights, bias = fit(
        np.diff(sizes.offsets.to_numpy()), sizes.flatten().to_numpy(), flat.flatten().to_numpy(), got.column(2).to_numpy(), len(number)
    )
    return Model(bias, {f: float(weights[i]) for f, i in number.items()})


def score_text(text: str | None, model: Model, words: _Words) -> tuple[float, list[int]]:
    """The document's score and the sentences (numbers from 0) with a probability of 0.5 or more."""
    log_clean, bad = 0.0, []
    get = words.__getitem__
    for i, s in enumerate(sentences(text)):
        z = model.bias + sum(map(get, s.split()))
        if z >= 0:
            bad.append(i)
        if z > -30:
            log_clean -= math.log1p(math.exp(z)) if z < 30 else z
    return abs(math.expm1(log_clean)), bad


@guarded
def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` plus ``__score`` (0 to 1) and ``__offending``, the numbers of the
    sentences to blame."""
    keep = df.columns
    schema = df.limit(0).withColumns(
        {"__score": F.lit(0.0), "__offending": F.array(F.lit(0))}
    ).schema

    def run(batches):
        words = _Words(model.weights)
        for batch in slices(batches, 500):
            at = batch.num_columns - 1
            out = [score_text(t, model, words) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))],
                names=schema.names,
            )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
