"""Operator 13: phrase collocation mining, by language.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces and those into words. All 1..max_n-grams of the
pieces become DataFrame rows (lang, phrase, n), counted by hash aggregation. A phrase of two or more words with a count of
``least`` is a candidate; joins with the counts of its first and last words give each cut's score, in Decimal; an anti-join
with its one-word extensions drops the candidates that a longer one explains; a window ranks the rest of each language.

Extensions by one word are enough: if a longer phrase has at least 80 % of a phrase's count, so has every phrase between them.

Phrases that can't reach ``least`` are not written out. A first pass sums hashes of words and word pairs, a second one those of three words
whose pairs are frequent (hashes can only add up too much, never too little) and marks the words in frequent pairs; cells of frequent ones are set in a bitmap of ``2 ** BITS`` bits (32 MiB),
which is broadcast, whatever the input. The third pass writes out the grams all of whose parts are set, added up by their strings within
a task first. A crowded bitmap only writes out more. The counts themselves are exact: by string, never by hash.

A null lang counts as ``und``, a null or empty text has no words. Repeated rows count each. Very long texts and words count whole;
ties in score and count are ranked by the phrase's bytes. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .scratch import written

#: Cells of the bitmap of frequent words and pairs are 2 ** BITS; RANGE of them travel in a row.
BITS, RANGE = 28, 1 << 19
#: Bytes of text that are cut into words at once; hashes, and phrases, that a task adds up before they leave it.
CHUNK, HASHES, HELD = 1 << 20, 1 << 21, 1 << 19
#: Bits of a hash that are counted: enough to tell words and pairs apart, and fewer bytes to send than all.
COUNTED = 44
#: Phrases whose bytes are gathered at once.
SLICE = 1 << 16
#: 0: in a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


class Words:
    """The words of some rows: bytes, word starts and ends, the piece and the row of each word."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = T.flat_text(column)
        self.data = data = T.lower_ascii(data)
        kind = _KIND[data]
        n = len(data)
        inside = np.zeros(n + 2, np.bool_)
        inside[1 : n + 1] = kind == 0
        first = np.zeros(n + 2, np.bool_)
        first[offsets + 1] = True
        self.starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | first[1 : n + 1]))
        self.ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2 : n + 2] | first[2 : n + 2])) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        cuts = np.cumsum(kind == 2, dtype=np.int32)
        self.pieces = (cuts[self.starts].astype(np.int64) if len(self.starts) else np.zeros(0, np.int64)) + self.rows  # both only grow

    def __len__(self) -> int:
        return len(self.starts)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The strings of ``size`` words from each word of ``at``, joined by one space; a slice of ``SLICE`` at a time."""
        return pa.concat_arrays([self._phrases(at[i : i + SLICE], size) for i in range(0, len(at), SLICE)])

    def _phrases(self, at: np.ndarray, size: int) -> pa.Array:
        words = (at[:, None] + np.arange(size)).ravel()
        lengths = self.ends[words] - self.starts[words] + 1
        lengths[size - 1 :: size] -= 1
        heads = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lengths, out=heads[1:])
        from_ = np.repeat(self.starts[words] - heads[:-1], lengths) + np.arange(heads[-1])
        out = np.append(self.data, np.uint8(32))[from_]
        ends = np.ones(len(words), np.bool_)
        ends[size - 1 :: size] = False
        out[heads[1:][ends] - 1] = 32
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(heads[:-1:size], heads[-1:]).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array, np.ndarray]]:
    """Words of about ``CHUNK`` bytes of text, the langs there and the lang number of each word."""
    for batch in batches:
        for start, stop in T.row_chunks(batch.column("text"), CHUNK):
            part = batch.slice(start, stop - start)
            words = Words(part.column("text"))
            if len(words):
                langs = part.column("lang").dictionary_encode()
                yield words, langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)[words.rows]


def hashes(words: Words, langs: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the one, two and three words from each word on, and whether the first two lie in one piece. The lang is hashed in."""
    data, offsets = T.flat_text(langs)
    seeds = T.word_hashes(data, offsets[:-1], offsets[1:], seed=1)[lang]
    single = T.word_hashes(words.data, words.starts, words.ends)
    pair, triple = (T.window_hashes(single, k) + np.uint64(k) for k in (2, 3))
    return *(T.mix64(x ^ seeds[: len(x)]) for x in (single, pair, triple)), words.pieces[1:] == words.pieces[:-1]


def frequent(documents: DataFrame, least: int, bits: int = BITS, known=None) -> np.ndarray:
    """The bitmap of words and pairs whose hashes add up to ``least``; with it as ``known``, that of three words whose pairs it has, and of the words in such pairs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        marked: list[np.ndarray] = []  # words that need no count: being in a frequent pair is enough

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            if marked:
                words = np.unique(np.concatenate(marked))
                values, counts = np.concatenate([values, words]), np.concatenate([counts, np.full(len(words), least)])
            kept.clear()
            marked.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int32))], ["h", "n"])

        for words, langs, lang in _chunks(batches):
            single, pair, triple, joined = hashes(words, langs, lang)
            if known is None:
                parts = (single, pair[joined])
            else:
                pairs = joined & is_set(pair, known.value)
                parts = (triple[pairs[:-1] & pairs[1:]],)
                used = np.append(pairs, False)
                used[1:] |= pairs
                marked.append(np.unique(as_part(single[used]) >> np.uint64(64 - COUNTED)))
            kept += [x >> np.uint64(64 - COUNTED) for x in parts]
            if sum(map(len, kept + marked)) > HASHES:
                yield flush()
        if kept:
            yield flush()

    # Tasks have added up what they can: rows are dealt by key at once, without another map-side sum.
    counted = documents.mapInArrow(sums, "h long, n int").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    cell = F.shiftright("h", COUNTED - bits)
    width = min(RANGE, 1 << bits)
    cells = counted.select(F.floor(cell / width).cast("int").alias("range"), (cell % width).cast("int").alias("cell")).distinct()

    def pack(table: pa.Table) -> pa.Table:  # at most ``width`` cells
        marks = np.zeros(width, np.uint8)
        marks[table.column("cell").to_numpy()] = 1
        return pa.table({"range": table.column("range")[:1], "bits": T.blob_array([np.packbits(marks).tobytes()])})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in cells.groupBy("range").applyInArrow(pack, "range int, bits binary").collect():  # at most 2**bits bits
        out[r["range"] * (width // 8) : (r["range"] + 1) * (width // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def as_part(single: np.ndarray) -> np.ndarray:
    """Other hashes of the same words: set for those that stand in a frequent pair."""
    return T.mix64(single + np.uint64(0x9E3779B97F4A7C15))


def is_set(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap) * 8).bit_length() - 1
    cell = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def gram_counts(documents: DataFrame, max_n: int = 4, least: int = 30, bits: int = BITS) -> DataFrame:
    """``lang, phrase, n`` of all phrases of 1 to ``max_n`` words found ``least`` times; the phrase '' has all words of its lang.

    Words that stand in no frequent pair are parts of no candidate and may be left out.
    """
    texts = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    share = documents.sparkSession.sparkContext.broadcast
    bitmap = share(frequent(texts, least, bits))
    if max_n > 2:
        pairs = bitmap
        bitmap = share(pairs.value | frequent(texts, least, bits, pairs))
        pairs.unpersist()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in table.combine_chunks().to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([b.column(c).cast(pa.string()) for c in ("lang", "phrase")] + [b.column("n")], ["lang", "phrase", "n"])

        for words, langs, lang in _chunks(batches):
            single, pair, triple, joined = hashes(words, langs, lang)
            pairs = joined & is_set(pair, bitmap.value)
            alive = is_set(as_part(single) if max_n > 2 else single, bitmap.value)
            names = langs.cast(pa.large_string())
            held.append(pa.table({"lang": names, "phrase": pa.array([""] * len(langs), pa.large_string()), "n": np.bincount(lang, minlength=len(langs)).astype(np.int64)}))
            for size in range(1, max_n + 1):
                if size == 2:
                    alive = pairs
                elif size == 3:
                    alive = triples = pairs[:-1] & pairs[1:] & is_set(triple, bitmap.value)
                elif size > 3:
                    alive = alive[:-1] & triples[size - 3 :]
                at = np.flatnonzero(alive)
                if not len(at):
                    break
                part = pa.table({"lang": pa.array(lang[at]), "phrase": words.phrases(at, size)}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                held.append(pa.table({"lang": names.take(part.column("lang").combine_chunks()), "phrase": part.column("phrase"), "n": part.column("count_all")}))
            if sum(map(len, held)) > 2 * HELD:
                held = [added()]
                if len(held[0]) > HELD:
                    yield from sent(held[0])
                    held = []
        if held:
            yield from sent(added())

    rows = texts.mapInArrow(grams, "lang string, phrase string, n long")
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _join(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(documents: DataFrame, max_n: int = 4, least: int = 30, percent: int = 80, top: int = 2000, scale: int = 2_000_000, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases."""
    counts = written(gram_counts(documents, max_n, least, bits), "grams")
    words = F.split("phrase", " ")
    phrases = counts.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("size"))
    candidates = phrases.where("size >= 2")
    known = counts.select("lang", "phrase", "n")

    cuts = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _join("words", F.lit(1), F.col("k")), "rest": _join("words", F.col("k") + 1, F.col("size"))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast({scale} as decimal(15,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.explode(F.array_distinct(F.array(_join("words", F.lit(1), F.col("size") - 1), _join("words", F.lit(2), F.col("size") - 1))))
    longer = candidates.where("size >= 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    c, x = scored.alias("c"), longer.alias("x")
    explained = F.expr(f"100 * cast(x.most as decimal(20,0)) >= {percent} * cast(c.a as decimal(20,0))")
    kept = c.join(x, (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & explained, "left_anti")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
