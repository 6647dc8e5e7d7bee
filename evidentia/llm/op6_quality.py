"""Operator 6: quality classifier, a hashed word n-gram logistic regression trained with FTRL-Proximal.

Words are split at white space and at the border of letters, digits and symbols, so that a run of symbols
is a word; each word counts as itself and as its shape, a word equal to the one before as a repeat. One-
and two-word grams of both are hashed to ``2 ** bits`` features. A score is the logistic of a sparse dot
product of a text's relative gram frequencies with the weights.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of doc_id. The driver
gets their features only and holds two vectors of ``2 ** bits`` numbers.

Null and empty texts score as the bias alone; very long ones count whole, as relative frequencies; equal texts score equally; repeated rows give
a row each; an empty table gives an empty result; further columns, of any name, are ignored (``accepted`` passes them on); without any label every score is 0.5. doc_id, source and lang are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Labelled rows that the model is fitted to, at most.
TRAIN_ROWS = 4000
BITS = 18
#: Character classes of a byte: 0 white space, 1 letter (and any byte of a longer code point), 2 digit, 3 symbol.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[48:58] = 2


def grams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, values (they sum to 10 in each part of a row) and the bounds of the rows."""
    data, offsets = T.flat_text(column)
    kind = _CLASS[data]
    n = len(data)
    edge = np.ones(n + 1, np.bool_)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    bounds = np.searchsorted(starts, offsets)
    words = T.word_hashes(data, starts, ends)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(bounds), np.int64)
    capital = (data >= 65) & (data <= 90)
    capitals = np.add.reduceat(np.append(capital, 0).astype(np.int64), starts)
    length = ends - starts
    inner = np.ones(len(words), np.bool_)  # not the first word of its row
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    glued = np.r_[False, starts[1:] == ends[:-1]] & inner
    shape = kind[starts].astype(np.uint64) * np.uint64(1000) + np.minimum(capitals, 2).astype(np.uint64) * np.uint64(100) + np.minimum(length, 12).astype(np.uint64) * np.uint64(4) + glued * np.uint64(2)
    symbol = kind[starts] == 3
    shape[symbol] = words[symbol]
    again = np.r_[False, (words[1:] == words[:-1])] & inner
    shape = T.mix64(shape + again.astype(np.uint64))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = rows[1:] == rows[:-1]
    parts = [words, T.window_hashes(words, 2)[pair], shape, T.window_hashes(shape, 2)[pair]]
    owners = [rows, rows[1:][pair], rows, rows[1:][pair]]
    feature = np.concatenate([T.mix64(x + np.uint64(i)) & np.uint64((1 << bits) - 1) for i, x in enumerate(parts)]).astype(np.int64)
    owner = np.concatenate(owners)
    value = np.concatenate([10.0 / np.bincount(o, minlength=len(bounds) - 1)[o] for o in owners])
    code, where = np.unique(owner * (1 << bits) + feature, return_inverse=True)
    return code & ((1 << bits) - 1), np.bincount(where, weights=value), np.searchsorted(code >> bits, np.arange(len(bounds)))


def logistic(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, float]:
    """Weights and bias after follow-the-regularised-leader updates, one row at a time in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(epochs):
        for feature, value, label in rows:
            f, x = np.append(feature, 1 << bits), np.append(value.astype(float), 1.0)
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            g = (logistic(float(w @ x)) - label) * x
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1].astype(np.float32), float(w[-1])


def row_scores(feature: np.ndarray, value: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each sparse row; a row is summed by itself, so that equal texts score equally wherever they stand."""
    products = np.append(weights[feature] * value, 0.0)
    sums = np.add.reduceat(products, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return logistic(np.where(np.diff(bounds) > 0, sums, 0.0) + bias)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, bits: int = BITS, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fitted to labelled rows that are not held out."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows short rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in T.row_chunks(batch.column("text")):
                part = batch.slice(start, stop - start)
                f, v, b = grams(part.column("text"), bits)
                rows = [(f[i:j].astype(np.int32).tobytes(), v[i:j].astype(np.float32).tobytes()) for i, j in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int32()), T.blob_array([x for x, _ in rows]), T.blob_array([x for _, x in rows])], ["doc_id", "quality", "f", "v"])

    got = sample.mapInArrow(features, "doc_id long, quality int, f binary, v binary").toArrow()
    # Views of the received columns: a row has no copy of its features.
    rows = [(d, np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), q.as_py()) for d, q, f, v in zip(T.mix64(got.column("doc_id").to_numpy()).tolist(), *(got.column(c) for c in ("quality", "f", "v")), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return ftrl([r[1:] for r in rows], bits)


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, bits: int = BITS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of documents."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels, bits, train_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for start, stop in T.row_chunks(batch.column("text")):
                part = batch.slice(start, stop - start)
                f, v, b = grams(part.column("text"), bits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(row_scores(f, v, b, weights, bias))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, bits: int = BITS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of documents, all columns, that score at least ``threshold``."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, bits, train_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for start, stop in T.row_chunks(batch.column("text")):
                part = batch.slice(start, stop - start)
                f, v, b = grams(part.column("text"), bits)
                yield part.filter(pa.array(row_scores(f, v, b, weights, bias) >= threshold))

    return documents.mapInArrow(keep, documents.schema)
