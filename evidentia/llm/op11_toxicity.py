"""Operator 11: toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding: lower case; letters without their marks; homoglyphs (Cyrillic, Greek, full-width and other forms) to Latin letters; digits
and signs that stand for letters, inside a word that has letters on both sides of them. What is left between letters is a space, so
that a text becomes words with one space before and after each.

The lexicon is learned from labelled texts: words and word beginnings, weighted by the log ratio of their rates in toxic and clean texts; an entry must
stand in more of the toxic texts than chance allows. Exception phrases are an entry's word with its neighbour (``clown fish``) that clean texts
hold at least as often as chance would have it; a match inside one counts nothing. Both can be given as well. Entries and exceptions form one automaton, which reads
each text once; a word counts its heaviest entry.

The score is a logistic function of the summed weights by length, fitted to the same labelled texts. Training takes at most ``TRAIN_ROWS`` labelled rows, those
with the smallest hash of doc_id; what reaches the driver is bounded: at most ``LEXICON`` entries, ``EXCEPTIONS`` phrases and two numbers a row.

Null and empty texts and those without a match score lowest; very long ones count whole, by length. Equal texts score equally, repeated rows get a row each. A null
doc_id is scored and never learned from. An empty table gives an empty result; further columns are ignored. Without labels of both kinds every score is 0.
doc_id, source and lang are no features.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from, entries and exception phrases that are kept, at most.
TRAIN_ROWS, LEXICON, EXCEPTIONS = 8000, 4096, 4096
#: Lengths of word beginnings that may be entries, and the length of the longest whole word (a longer one counts by its beginning).
SHORT, LONG, WORD = 3, 12, 40
#: Places of a gram in one text that count, at most: a text that repeats itself is no evidence of its own.
MOST = 20
#: Words that are added to a text's length, so that one match in a short text is no whole rate.
PAD = 50
#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = str.maketrans("аеорсухкмтвнгіјѕԁԛԝһɡıαεορυκντιχγωηβƒøđłßæ", "aeopcyxkmtbhrijsdqwhgiaeopuknvixywnbfodlsa")
DIGITS = str.maketrans("0134578@$!|€£", "oieastbasiiel")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!|€£]+(?=[^\W\d_])")
_APART = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """The folded words of a text, with a space before and after each; ' ' without any."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(HOMOGLYPHS)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = _INSIDE.sub(lambda m: m.group().translate(DIGITS), text)
    return f" {_APART.sub(' ', text).strip()} ".replace("  ", " ")


def grams(text: str) -> Counter[str]:
    """Whole words (' word ') and word beginnings (' wor') of a folded text, and how often each stands there."""
    out: Counter[str] = Counter()
    for word, n in Counter(text.split()).items():
        if len(word) <= WORD:
            out[f" {word} "] += n
        for k in range(SHORT, min(LONG, len(word)) + 1):
            out[f" {word[:k]}"] += n
    return out


class Lexicon:
    """An automaton of weighted entries and exception phrases over folded texts."""

    def __init__(self, entries: dict[str, float], exceptions: frozenset[str] = frozenset()) -> None:
        self.entries, self.exceptions = entries, exceptions
        self.automaton = ahocorasick.Automaton()
        for pattern in {*entries, *exceptions}:
            self.automaton.add_word(pattern, (len(pattern), entries.get(pattern), pattern in exceptions))
        if entries:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, float]:
        """Of a folded text: the heaviest entry at each word's place, without words inside an exception phrase."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not self.entries:
            return found
        for end, (length, weight, exception) in self.automaton.iter(text):
            start = end - length + 1
            if weight is not None and weight > found.get(start, 0.0):
                found[start] = weight
            if exception:
                spared.append((start, end))
        for start, end in spared:
            for at in [at for at in found if start <= at < end]:
                del found[at]
        return found

    def rate(self, text: str) -> float:
        """Summed weights by length, as log(1 + 1000 * sum / (words + PAD))."""
        said = folded(text)
        return float(np.log1p(1000 * sum(self.matches(said).values()) / (said.count(" ") - 1 + PAD)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of the rows that are learned from: at most ``train_rows`` ids, none held out."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _counted(rows: DataFrame, of) -> DataFrame:
    """Of each gram of ``of(folded text)``: toxic and clean texts that hold it (``pos, neg``) and its places there (``often, seldom``), at most ``MOST`` a text;
    added up within a task first. The gram '' stands for all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        places: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(texts[0].keys() | texts[1].keys())
            columns = [pa.array([c[g] for g in names], pa.int64()) for c in (texts[1], texts[0], places[1], places[0])]
            for c in (*texts, *places):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["gram", "pos", "neg", "often", "seldom"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                said = folded(text.as_py())
                found = of(said)
                texts[toxic].update(found.keys())
                places[toxic].update({g: min(n, MOST) for g, n in found.items()})
                texts[toxic][""] += 1
                places[toxic][""] += said.count(" ") - 1
                if len(texts[0]) + len(texts[1]) > 200_000:
                    yield flush()
        yield flush()

    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "often", "seldom")]
    return rows.mapInArrow(count, "gram string, pos long, neg long, often long, seldom long").groupBy("gram").agg(*sums)


def _least(a: str, b: str, all_a: int, all_b: int, errors: float) -> Column:
    """Log of the ratio of two rates, less so many standard errors."""
    x, y = F.col(a) + 0.5, F.col(b) + 0.5
    return F.log(x / (all_a + 1)) - F.log(y / (all_b + 1)) - errors * F.sqrt(1 / x + 1 / y)


def chosen(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of the entries worth keeping of ``gram: (places, weight)``."""
    kept: dict[str, float] = {}
    longest: dict[str, int] = {}  # places of the most frequent longer entry, by beginning
    for gram, (often, _) in found.items():
        for k in range(SHORT + 1, len(gram)):
            # A whole word of five letters or more counts by its beginning, which its inflections share.
            if gram[-1] != " " or (k < len(gram) - 1) or k < 6:
                longest[gram[:k]] = max(longest.get(gram[:k], 0), often)
    for gram in sorted(found, key=lambda g: (len(g), g)):
        often, weight = found[gram]
        if longest.get(gram, 0) >= 0.98 * often:
            continue  # a longer entry stands at all its places and is more to the point
        if all(kept.get(gram[:k], 0.0) < weight for k in range(SHORT + 1, len(gram))):
            kept[gram] = weight  # else it says no more than the entry it begins with
    return kept


def learn(rows: DataFrame, margin: float = 0.5, ratio: float = 2.0, size: int = LEXICON, given: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """The lexicon of ``text, toxic`` rows. ``given`` entries (folded, ' word ' or ' begin') and exceptions are kept besides the learned ones.

    An entry's log ratio by texts must pass ``margin`` by two standard errors; its weight is its log ratio by places, less one error, and must pass ``ratio``.
    """
    counted = _counted(rows, grams)
    said = counted.where("gram = ''").first()
    entries: dict[str, float] = {}
    both = bool(said and said["pos"] and said["neg"])
    if both:
        best = counted.where("gram <> '' and pos >= 3").withColumns({"least": _least("pos", "neg", said["pos"], said["neg"], 2.0), "weight": _least("often", "seldom", said["often"], said["seldom"], 1.0)})
        best = best.where((F.col("least") > margin) & (F.col("weight") > ratio)).orderBy(F.desc("least"), "gram").limit(size)
        entries = chosen({r["gram"]: (r["often"], r["weight"]) for r in best.collect()})
    lexicon = Lexicon(entries | (given or {}))

    def phrases(text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        for at in lexicon.matches(text):
            end = text.index(" ", at + 1)
            if at:
                out[text[text.rindex(" ", 0, at) : end + 1]] += 1
            if end + 1 < len(text):
                out[text[at : text.index(" ", end + 1) + 1]] += 1
        return out

    if both and lexicon.entries:
        rate = F.log((F.col("pos") + 0.5) / (said["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (said["neg"] + 1))
        spared = _counted(rows, phrases).where((F.col("gram") != "") & (F.col("neg") >= 3) & (rate <= 0)).orderBy(F.desc("neg"), "gram").limit(EXCEPTIONS)
        exceptions = exceptions | {r["gram"] for r in spared.collect()}
    return Lexicon(lexicon.entries, exceptions)


def calibrate(rates: np.ndarray, toxic: np.ndarray, penalty: float = 0.01) -> tuple[float, float]:
    """Slope and bias of a logistic function of the rate, by Newton steps."""
    x = np.stack([rates, np.ones(len(rates))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(2), x.T @ (p - toxic) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, given: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset()) -> tuple[Lexicon, float, float]:
    """Lexicon, slope and bias."""
    rows = labelled(documents, labels, train_rows)
    lexicon = learn(rows, given=given, exceptions=exceptions)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.rate(t.as_py()) for t in batch.column("text")], pa.float64()), batch.column("toxic").cast(pa.int32())], ["rate", "toxic"])

    # Equal rates are counted before they are collected, so that repeated rows of an id cost nothing.
    got = rows.mapInArrow(rate, "rate double, toxic int").groupBy("rate", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("rate", "toxic").toPandas()
    if got["toxic"].nunique() < 2:
        return lexicon, 0.0, -35.0
    return lexicon, *calibrate(np.repeat(got["rate"].to_numpy(), got["n"]), np.repeat(got["toxic"].to_numpy(float), got["n"]))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS, given: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset()) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_matches`` of each row of documents."""
    lexicon, slope, bias = train(documents, labels, train_rows, given, exceptions)
    model = documents.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, slope, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, exceptions, slope, bias = model.value
        lexicon = Lexicon(entries, exceptions)
        for batch in batches:
            rates, hits = [], []
            for text in batch.column("text"):
                said = folded(text.as_py() or "")
                found = lexicon.matches(said)
                hits.append(len(found))
                rates.append(1000 * sum(found.values()) / (said.count(" ") - 1 + PAD))
            z = np.clip(slope * np.log1p(np.array(rates)) + bias, -35, 35)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)), pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "n_matches"])

    scored = documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, n_matches long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")
