"""Operator 9: exact substring deduplication behind a count-min prefilter.

A window is ``size`` consecutive words of one document; a word goes if a window that covers it also starts
in a document with a smaller doc_id. Two passes read the texts:

1. Every partition sketches its windows. A window is counted under its core, the ``size // 2 + 1``-word gram in
   it with the smallest hash: equal windows have equal cores, and a document counts once for a core, so a
   cell never counts less than the documents that hold a window. Two rows of cells are merged by cell range
   and only the bit "two or more" of each cell is kept and broadcast: 2 * 2**bits bits, whatever the input.
2. Windows whose cells all say "two or more" are grouped exactly, by a 96-bit hash: first within the task, which
   keeps only the occurrences in its smallest document, then by hash slices. Each occurrence in a larger doc_id than
   the smallest of its group is removed. A window that the sketch drops occurs in one document alone, so none is lost.

A crowded sketch (input far above 2**bits cores) only sends more windows to the exact pass.

Nulls: a null text has no words; a row without doc_id neither loses words nor takes others'. Rows that
repeat a doc_id are judged each by itself, never against each other. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import tasks, written

#: Cells of a sketch row are 2 ** BITS; the broadcast is 2 * 2 ** BITS bits (32 MiB).
BITS = 27
DEPTH = 2
#: Cell ranges of a sketch row that are merged apart.
RANGES = 64
#: Cores, and windows of the exact pass, that a task gathers before it sends them.
FLUSH, FLUSH_WINDOWS = 1 << 20, 1 << 18
#: Bytes of text whose windows are made at once: they take up to sixty times as much memory.
CHUNK = 1 << 18


def windows(column: pa.Array, size: int) -> tuple[np.ndarray, ...]:
    """Of each window: its row, its first word, its core, its 64-bit hash and 32 further bits."""
    data, offsets = T.flat_text(column)
    starts, ends, bounds = T.word_spans(data, offsets)
    words = T.word_hashes(data, starts, ends)
    at, rows = T.window_rows(bounds, size, 0)
    if not len(at):
        return rows, at, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.uint32)
    gram = size // 2 + 1
    small = T.window_hashes(words, gram)
    count = len(words) - size + 1
    core = small[:count].copy()
    for k in range(1, size - gram + 1):
        np.minimum(core, small[k : k + count], out=core)
    full = T.window_hashes(words, size)
    more = T.window_hashes(T.word_hashes(data, starts, ends, seed=1), size)
    return rows, at - bounds[rows], core[at], full[at], (more[at] >> np.uint64(32)).astype(np.uint32)


def cells(core: np.ndarray, row: int, bits: int) -> np.ndarray:
    return T.mix64(core + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)


def _deltas(values: np.ndarray) -> bytes:
    gaps = np.diff(values, prepend=values[:1])
    wide = len(gaps) > 0 and int(gaps.max()) > 65535
    return np.uint32(values[0]).tobytes() + bytes([wide]) + gaps.astype(np.uint32 if wide else np.uint16).tobytes()


def _undelta(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, 1)[0] + np.cumsum(np.frombuffer(blob, np.uint32 if blob[4] else np.uint16, offset=5), dtype=np.int64)


def sketch_parts(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Cells that the task met (twice if more than once), packed by range: range, cells."""
    kept: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        core = np.concatenate(kept)
        names, blobs = [], []
        shift = bits - int(np.log2(RANGES))
        for row in range(DEPTH):
            values, counts = np.unique(cells(core, row, bits).astype(np.int64), return_counts=True)
            values = np.repeat(values, np.minimum(counts, 2))
            cuts = np.searchsorted(values, np.arange(RANGES + 1, dtype=np.int64) << shift)
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    names.append(row * RANGES + i)
                    blobs.append(_deltas(values[a:b] - (i << shift)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), T.blob_array(blobs)], ["range", "cells"])

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid()) if batch.column("doc_id").null_count else batch
        for start, stop in T.row_chunks(batch.column("text"), CHUNK):
            rows, _, core, _, _ = windows(batch.column("text").slice(start, stop - start), size)
            if len(core):
                order = np.lexsort((core, rows))
                core, rows = core[order], rows[order]
                kept.append(core[np.r_[True, (core[1:] != core[:-1]) | (rows[1:] != rows[:-1])]])
            if sum(map(len, kept)) > FLUSH:
                yield flush()
                kept = []
    if kept:
        yield flush()


def repeated_cells(documents: DataFrame, size: int, bits: int) -> np.ndarray:
    """The merged sketch: a bit for each cell, set if its count is two or more; rows one after the other."""
    width = (1 << bits) // RANGES

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(width, np.uint8)
        for blob in table.column("cells"):
            found, times = np.unique(_undelta(blob.as_py()), return_counts=True)
            counts[found] = np.minimum(counts[found] + np.minimum(times, 2), 2)
        return pa.table({"range": table.column("range")[:1], "bits": T.blob_array([np.packbits(counts > 1).tobytes()])})

    parts = documents.mapInArrow(lambda b: sketch_parts(b, size, bits), "range int, cells binary")
    merged = parts.groupBy("range").applyInArrow(merge, "range int, bits binary")
    out = np.zeros(DEPTH * (1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator():  # DEPTH * RANGES rows of a fixed size
        out[r["range"] * (width // 8) : (r["range"] + 1) * (width // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def estimated_repeated(core: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(core), np.bool_)
    for row in range(DEPTH):
        cell = cells(core, row, bits) + np.uint64(row << bits)
        out &= (sketch[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return out


def _spread(docs: np.ndarray, marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Window starts gathered by document row: doc_id, mark, packed starts."""
    order = np.lexsort((at, marks, docs))
    docs, marks, at = docs[order], marks[order], at[order]
    heads = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])]) if len(docs) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(docs)]
    return docs[heads], marks[heads], [at[a:b].astype(np.uint32).tobytes() for a, b in zip(heads, ends, strict=False)] if len(docs) else []


_FOUND = "slice int, doc_id long, mark long, starts binary"


def candidates(batches: Iterator[pa.RecordBatch], size: int, bits: int, sketch, slices: int) -> Iterator[pa.RecordBatch]:
    """Rows of slice >= 0: packed windows for the exact pass. Rows of slice -1: windows that this task knows to be removed."""
    kept: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        docs, marks, at, core, full, more = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((docs, more, full))
        head = np.r_[True, (full[order][1:] != full[order][:-1]) | (more[order][1:] != more[order][:-1])]
        least = docs[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        gone = np.zeros(len(docs), np.bool_)
        gone[order] = docs[order] > least
        d, m, blobs = _spread(docs[gone], marks[gone], at[gone])
        names = [-1] * len(d)
        stay = ~gone
        docs, marks, at, core, full, more = (x[stay] for x in (docs, marks, at, core, full, more))
        part = (T.mix64(core) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(slices + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                o = order[a:b]
                names.append(i)
                blobs.append(full[o].tobytes() + docs[o].tobytes() + marks[o].tobytes() + more[o].tobytes() + np.diff(at[o], prepend=0).astype(np.int32).tobytes())
        n = len(names) - len(d)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(np.r_[d, np.zeros(n, np.int64)].astype(np.int64)), pa.array(np.r_[m, np.zeros(n, np.int64)].astype(np.int64)), T.blob_array(blobs)], ["slice", "doc_id", "mark", "starts"])

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid()) if batch.column("doc_id").null_count else batch
        docs = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy(zero_copy_only=False)
        for start, stop in T.row_chunks(batch.column("text"), CHUNK):
            rows, at, core, full, more = windows(batch.column("text").slice(start, stop - start), size)
            use = estimated_repeated(core, sketch.value, bits)
            if kept and sum(len(x[0]) for x in kept) + int(use.sum()) > FLUSH_WINDOWS:
                yield flush()
                kept = []
            if use.any():
                rows = rows[use] + start
                kept.append((docs[rows], marks[rows], at[use].astype(np.int64), core[use], full[use], more[use]))
    if kept:
        yield flush()


def judged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Exact groups of one slice: the windows with a larger doc_id than the smallest of their group."""
    parts = []
    for blob in blobs:
        k = len(blob) // 32
        parts.append((np.frombuffer(blob, np.uint64, k), np.frombuffer(blob, np.int64, k, 8 * k), np.frombuffer(blob, np.int64, k, 16 * k), np.frombuffer(blob, np.uint32, k, 24 * k), np.cumsum(np.frombuffer(blob, np.int32, k, 28 * k), dtype=np.int64)))
    full, docs, marks, more, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((docs, more, full))
    full, docs, marks, more, at = full[order], docs[order], marks[order], more[order], at[order]
    head = np.r_[True, (full[1:] != full[:-1]) | (more[1:] != more[:-1])]
    gone = docs > docs[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return _spread(docs[gone], marks[gone], at[gone])


def rebuilt(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in T.row_chunks(whole.column("text")):
            batch = whole.slice(start, stop - start)
            kept, counts, removed = [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found"), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                blobs = found.as_py()
                if blobs:
                    starts = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    words = list(compress(words, stay.tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(documents: DataFrame, size: int = 13, bits: int = BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row; kept are the words left, joined by one space."""
    spark = documents.sparkSession
    source = documents.select("doc_id", "text")
    marked = source.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    sketch = spark.sparkContext.broadcast(repeated_cells(source, size, bits))
    slices = 3 * max(tasks(spark), 8)
    found = written(marked.mapInArrow(lambda b: candidates(b, size, bits, sketch, slices), _FOUND), "windows")
    sketch.destroy()

    def exact(table: pa.Table) -> pa.Table:
        docs, marks, blobs = judged([x.as_py() for x in table.column("starts")])
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "mark": pa.array(marks, pa.int64()), "starts": T.blob_array(blobs)})

    grouped = found.where("slice >= 0").groupBy("slice").applyInArrow(exact, "doc_id long, mark long, starts binary")
    gone = found.where("slice < 0").select("doc_id", "mark", "starts").union(grouped)
    gone = gone.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list("starts").alias("found"))
    joined = marked.join(gone, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(lambda b: rebuilt(b, size), "doc_id long, n_words long, n_removed long, kept string")
