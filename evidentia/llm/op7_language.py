"""Operator 7: language identification by mixture inference.

Each language is a distribution over hashed character trigrams (lower case, words padded by a space),
learnt from labelled texts. A document is a mixture of languages: expectation-maximisation estimates the
proportions from the trigram likelihoods of a set of languages. The set starts with the likeliest language and grows
by one language at a time while that raises the penalised likelihood (half a logarithm of the trigram count and two for
each further proportion); languages are tried by the slope of the likelihood towards them, over all that were learnt,
and only those whose slope shows that they can't gain the penalty are passed over. The size of the set has no limit.
``lang_pred`` has the largest proportion in that set, ``score`` is that proportion.

The fit takes at most ``TRAIN_ROWS`` texts of each language, those with the smallest hash of doc_id; the
model is languages x ``BUCKETS`` numbers, for every language with a labelled text.

Null texts and texts without letters get ``und`` and score 0; so does everything if nothing was learnt. Ties
go to the first language in alphabetical order. Very long texts count whole. Repeated rows give a row each, an empty table an empty result;
further columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

BUCKETS = 4096
#: Texts of each language in the fit, at most.
TRAIN_ROWS = 1000
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _LETTER[0]


def trigram_counts(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """A row of trigram counts for each text. Anything but a letter is a space; trigrams of spaces around nothing are left out."""
    texts = [(x or "").lower() for x in column.to_pylist()]
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(codes == 0)
    code = np.where(letter_table()[codes], codes, 0).astype(np.uint64)
    if len(code) < 1:
        return np.zeros((len(texts), buckets), np.float32)
    padded = np.concatenate([np.zeros(1, np.uint64), code, np.zeros(1, np.uint64)])
    mixed = T.mix64(padded[:-2] * np.uint64(1 << 42) + padded[1:-1] * np.uint64(1 << 21) + padded[2:]) % np.uint64(buckets)
    use = code > 0
    if row[-1] >= len(texts):  # a text held a NUL itself: count row by row
        return np.concatenate([trigram_counts(pa.array([t.replace("\0", " ")]), buckets) for t in texts])
    flat = np.bincount(row[use] * buckets + mixed[use].astype(np.int64), minlength=len(texts) * buckets)
    return flat.reshape(len(texts), buckets).astype(np.float32)


def train(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log-smoothed trigram distributions."""
    labelled = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Spark keeps the first rows of each partition before it deals them out, so a language with most rows costs no more.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_rows)
    sample = labelled.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")  # at most train_rows numbers a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, stop in T.row_chunks(batch.column("text")):
                part = batch.slice(start, stop - start)
                rows = trigram_counts(part.column("text"))
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + rows[names == name].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), T.blob_array([x.tobytes() for x in sums.values()])], ["lang", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py()) for x in parts.column("counts"))
        return pa.table({"lang": parts.column("lang").slice(0, 1), "counts": pa.array([sums.tobytes()], pa.binary())})

    counted = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    total = {r["lang"]: np.frombuffer(r["counts"]) for r in counted.collect()}
    if not total:
        return [], np.zeros((0, BUCKETS))
    names = sorted(total)
    raw = np.stack([total[k] for k in names]) + 0.5
    return names, raw / raw.sum(axis=1, keepdims=True)


def _fitted(counts: np.ndarray, p: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row's allowed languages after ``rounds`` of expectation-maximisation, and the log-likelihood."""
    theta = allowed / allowed.sum(axis=1, keepdims=True, dtype=np.float32)
    for _ in range(rounds):
        theta = theta * ((counts / np.maximum(theta @ p, 1e-30)) @ p.T)
        theta /= np.maximum(theta.sum(axis=1, keepdims=True), 1e-30)
    return theta, (counts * np.log(np.maximum(theta @ p, 1e-30))).sum(axis=1, dtype=np.float64)


def mixture(counts: np.ndarray, model: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of the language with the largest proportion in the best set, and that proportion."""
    n, k = len(counts), len(model)
    size = counts.sum(axis=1, dtype=np.float64)
    penalty = np.log(np.maximum(size, 1)) / 2 + 2
    p = model.astype(np.float32)
    single = counts @ np.log(model).T.astype(np.float32)
    theta = np.zeros((n, k), np.float32)
    theta[np.arange(n), single.argmax(axis=1)] = 1.0
    chosen = theta > 0
    score = single.max(axis=1, initial=-np.inf).astype(np.float64)  # penalised, but for what all sets share

    def slopes(rows: np.ndarray) -> np.ndarray:
        """What each language could add to the likelihood at most, -inf for those in the set. The likelihood is concave."""
        up = (counts[rows] / np.maximum(theta[rows] @ p, 1e-30)) @ p.T - size[rows, None]
        # Where the fit of the set itself is unfinished, a language may also gain what is left of that.
        left = np.maximum(np.where(chosen[rows], up, 0).max(axis=1, keepdims=True), 0)
        return np.where(chosen[rows], -np.inf, up + left)

    rows = np.arange(n)
    gain = slopes(rows)
    while len(rows):
        open_ = gain.max(axis=1) > penalty[rows]
        rows, gain = rows[open_], gain[open_]
        if not len(rows):
            break
        tried = gain.argmax(axis=1)
        allowed = chosen[rows]
        allowed[np.arange(len(rows)), tried] = True
        new, fit = _fitted(counts[rows], p, allowed, rounds)
        fit -= (allowed.sum(axis=1) - 1) * penalty[rows]
        better = fit > score[rows]
        gain[np.arange(len(rows)), tried] = -np.inf  # not again before the set has grown
        grown = rows[better]
        theta[grown], chosen[grown], score[grown] = new[better], allowed[better], fit[better]
        if len(grown):
            gain[better] = slopes(grown)
    return theta.argmax(axis=1), np.where(size > 0, theta.max(axis=1), 0.0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row."""
    learnt = documents.sparkSession.sparkContext.broadcast(train(documents, train_rows))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = learnt.value
        for batch in batches:
            for start, stop in T.row_chunks(batch.column("text")):
                part = batch.slice(start, stop - start)
                counts = trigram_counts(part.column("text"))
                known = counts.sum(axis=1) > 0 if names else np.zeros(len(counts), np.bool_)
                pred, score = np.full(len(counts), "und", object), np.zeros(len(counts))
                if known.any():
                    best, share = mixture(counts[known], model)
                    pred[known], score[known] = np.array(names, object)[best], np.clip(share, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = documents.select("doc_id", "text").mapInArrow(infer, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
