"""Operator 2: quality rules per document, and host-level verdicts joined back to the documents.

The base rules measure each whole text. Failures of several rules (``HOST_RULES``) are then counted by host (the ``source`` column
or another); each host's failure rates are shrunk towards the corpus by beta priors
whose parameters are fitted to all hosts by moments (empirical Bayes). A host with a shrunken rate far above a
rule's prior is rejected with all its documents, which a join brings back to them.

Nulls: a null text has no words (and so fails), a null host is a host of its own. Empty texts have no words; very long ones are
measured whole. Equal lines and windows tie by nothing: all but the first line count, all windows count. Repeated rows give a row
each, an empty table gives an empty result, other columns (of any name) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The symbols that count, as bytes.
SYMBOLS = np.zeros(256, np.bool_)
SYMBOLS[list(b"#*$%&|<>")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measures(column: pa.Array, size: int = 5) -> dict[str, np.ndarray]:
    data, offsets = T.flat_text(column)
    starts, ends, bounds = T.word_spans(data, offsets)
    counts = np.diff(bounds)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside)[: len(data)] > 0
    out = {"n_words": counts, "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_row(SYMBOLS[data], offsets)}

    words = T.word_hashes(data, starts, ends)
    at, rows = T.window_rows(bounds, size, 0)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        hashes = T.window_hashes(words, size)[at]
        order = np.lexsort((hashes, rows))
        same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        twice = np.zeros(len(at), np.bool_)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + size, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(covered)[: len(words)] > 0, bounds)

    # Lines: a break ends a line; rows end lines too.
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    stop = np.minimum(np.r_[cut[1:], len(data)], len(data))
    stop = stop - ((stop > cut) & (data[np.maximum(stop, 1) - 1] == 10))
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    cut, stop = cut[filled], stop[filled]
    row = np.searchsorted(offsets, cut, "right") - 1
    line = T.word_hashes(data, cut, stop)
    order = np.lexsort((line, row))
    repeat = np.zeros(len(line), np.int64)
    repeat[1:] = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order], weights=repeat, minlength=len(counts)).astype(np.int64)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for start, stop in T.row_chunks(column):
            rows = batch.slice(start, stop - start)
            found = measures(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("host").cast(pa.string()), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], ["doc_id", "host", *MEASURES])


def base_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, the measures and ``base_failed`` of each row."""
    types = ", ".join(f"{k} long" for k in MEASURES)
    rows = documents.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(_measured, f"doc_id long, host string, {types}")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: Rules counted by host, on the measures of a document.
HOST_RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "n_dup_lines >= 5",
}


def host_verdicts(rows: DataFrame, deviations: float = 3.0, reach: float = 0.5) -> DataFrame:
    """``host, n_docs`` and, of each rule, ``failed_``, ``rate_`` (posterior mean), ``limit_``; ``host_ok`` if no rate exceeds its limit.

    Each rule has its own prior. Its mean m is the mean of the hosts' rates and its strength s = m (1 - m) / v - 1, where v is
    the variance of the rates less the part that sampling explains; without such variance s is the mean
    number of documents of a host (full pooling would forget the host altogether). The limit lies ``deviations`` standard
    deviations of that beta prior, sqrt(m (1 - m) / (s + 1)), above its mean, but at most
    ``reach`` of the way from the mean to certain failure (few hosts, one of them bad, make a wide prior). Both are relative to the mean: where every
    host fails often, none is rejected for that, and its failing documents go by the base rules alone.
    """
    counts = [F.sum(F.expr(rule).cast("long")).alias(f"failed_{name}") for name, rule in HOST_RULES.items()]
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *counts)
    moments = [F.avg("n_docs").alias("size"), F.avg(1 / F.col("n_docs")).alias("inverse")]
    for name in HOST_RULES:
        rate = F.col(f"failed_{name}") / F.col("n_docs")
        moments += [F.avg(rate).alias(f"m_{name}"), F.var_pop(rate).alias(f"v_{name}")]
    joined = hosts.crossJoin(F.broadcast(hosts.agg(*moments)))  # the prior is a single row
    ok = F.lit(True)
    out = ["host", "n_docs"]
    for name in HOST_RULES:
        m = F.col(f"m_{name}")
        between = F.col(f"v_{name}") - m * (1 - m) * F.col("inverse")
        s = F.greatest(F.lit(1.0), F.when(between > 0, m * (1 - m) / between - 1).otherwise(F.col("size")))
        rate = (F.col(f"failed_{name}") + m * s) / (F.col("n_docs") + s)
        limit = m + F.least(reach * (1 - m), deviations * F.sqrt(m * (1 - m) / (s + 1)))
        joined = joined.withColumn(f"rate_{name}", rate).withColumn(f"limit_{name}", limit)
        ok = ok & (F.col(f"rate_{name}") <= F.col(f"limit_{name}") + 1e-12)
        out += [f"failed_{name}", f"rate_{name}", f"limit_{name}"]
    return joined.select(*out, ok.alias("host_ok"))


def quality_rules(documents: DataFrame, host: str = "source", deviations: float = 3.0) -> DataFrame:
    """Base measures, ``base_failed`` and ``kept`` (no base failure and an accepted host) of each row."""
    rows = written(base_rules(documents, host), "measures")  # texts are measured once
    verdicts = host_verdicts(rows, deviations).select(F.col("host").alias("verdict_of"), "host_ok")
    return rows.join(verdicts, rows["host"].eqNullSafe(verdicts["verdict_of"]), "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept")
    )
