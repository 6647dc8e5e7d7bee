"""Operator 10: byte-level BPE encoding and decoding by corpus-level merge replay.

Documents are read in blocks (one Arrow batch). The distinct words of a block form one flat symbol array with
an inverted index from the rank of a mergeable pair to the positions where it stands. Ranks are replayed in
order; each merge is applied to all its positions at once and only the neighbours it touches are ranked
again. A word's result depends on the word alone, so blocks and their order don't matter; a task keeps
at most ``CACHE_WORDS`` results for its next block.

Null texts count as empty (no ids). Repeated rows give a row each; an empty table gives an empty result. A single
word of any length is one array; memory is bounded by a block's texts.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words whose ids a worker keeps between blocks.
CACHE_WORDS = 500_000
#: Positions of a merge from which on it is applied by array operations; fewer are done one by one.
ARRAY_MERGE = 64
#: Stands for the symbol beside a word's edge.
NONE = (1 << 20) - 1
_LOADED: dict[tuple[str, str], Vocabulary] = {}


#: Two white spaces in a row; elsewhere a space always begins a match of the pattern (or is one).
_DOUBLE_SPACE = re.compile(r"\s\s")


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


class Vocabulary:
    """Ranks of byte strings, the pairs of them that merge, and the pattern that splits a text."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.tokens[v] = k
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[k[:i]] << 20) | ranks[k[i:]]: v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        keys = sorted(pairs)
        self.pairs = pairs
        self.pair_keys = np.array([*keys, 1 << 62], np.int64)  # a last key that no pair has
        self.pair_ranks = np.array([*(pairs[k] for k in keys), -1], np.int64)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = Vocabulary(path, pattern)
        return _LOADED[path, pattern]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that a pair merges to, -1 for none; ``NONE`` merges with nothing."""
        key = (left << 20) | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """The plain rule: merge the leftmost pair of the lowest rank until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (packed 32-bit), by one replay of the ranks over all words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        ends = np.cumsum(lengths)
        firsts = (ends - lengths)[lengths > 0]
        symbol = np.append(self.byte_ids[flat], NONE)
        after = np.arange(1, n + 2, dtype=np.int64)
        after[ends[lengths > 0] - 1] = n
        before = np.arange(-1, n, dtype=np.int64)
        before[firsts] = n
        before[n] = after[n] = n
        rank = self.rank(symbol, symbol[after])
        odd: set[int] = set()  # positions where a merge made a pair of a lower rank: their words follow the plain rule
        index: dict[int, list] = {}
        queue: list[int] = []
        symbols, afters, befores, ranks, pairs = *map(memoryview, (symbol, after, before, rank)), self.pairs

        def enter(at: np.ndarray) -> None:
            r = rank[at]
            use = r >= 0
            at, r = at[use], r[use]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)]).tolist()
            for a, b in zip(heads, [*heads[1:], len(r)], strict=False):
                k = int(r[a])
                if k not in index:
                    index[k] = []
                    heapq.heappush(queue, k)
                if b - a > ARRAY_MERGE:
                    index[k].append(at[a:b])
                else:
                    index[k] += at[a:b].tolist()

        def one(at: int, r: int) -> None:
            gone = afters[at]
            follow = afters[gone]
            symbols[at], ranks[gone], afters[at] = r, -1, follow
            befores[follow] = at
            for x in (at, befores[at]):
                if x < n:
                    k = ranks[x] = pairs.get((symbols[x] << 20) | symbols[afters[x]], -1)
                    if k >= 0:
                        if k in index:
                            index[k].append(x)
                        else:
                            index[k] = [x]
                            heapq.heappush(queue, k)
                        if k < r:
                            odd.add(x)

        enter(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            arrays = [x for x in found if not isinstance(x, int)]
            if not arrays and len(found) <= ARRAY_MERGE:
                for at in sorted(found):
                    if ranks[at] == r:
                        one(at, r)
                continue
            at = np.concatenate([*arrays, np.array([x for x in found if isinstance(x, int)], np.int64)])
            at = _sorted_set(at[rank[at] == r])
            overlaps = after[at[:-1]] == at[1:]
            if overlaps.any():  # a run such as aaaa: take the first, third, ... pair of it
                heads = np.r_[True, ~overlaps]
                at = at[(np.arange(len(at)) - np.flatnonzero(heads)[np.cumsum(heads) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at] = r
            rank[gone] = -1
            after[at] = follow
            before[follow] = at
            touched = _sorted_set(np.concatenate([at, before[at]]))
            touched = touched[touched < n]
            new = rank[touched] = self.rank(symbol[touched], symbol[after[touched]])
            odd.update(touched[(new >= 0) & (new < r)].tolist())
            enter(touched)
        live = self._live(n, after, firsts)
        ids = symbol[:n][live].astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(live)])
        data, bounds = ids.tobytes(), (4 * cuts).tolist()
        out = [data[bounds[a] : bounds[b]] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        for i in np.unique(np.searchsorted(ends, np.array(sorted(odd), np.int64), "right")):
            out[i] = np.array(self.one_word(words[i]), np.uint32).tobytes()
        return out

    @staticmethod
    def _live(n: int, after: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions that are a word's first symbol or follow a living one."""
        live = np.zeros(n + 1, np.bool_)
        at = firsts
        while len(at):
            live[at] = True
            at = after[at]
            at = at[at < n]
        return live[:n]

    def encode_words(self, words: set[str]) -> None:
        """Fills ``known`` with matches of the pattern."""
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text.

        A text without two white spaces in a row is cut before each space, which is where a match begins
        whatever stands around it; such pieces repeat a lot and each is split by the pattern once.
        """
        if len(self.known) + len(self.spaced) > CACHE_WORDS:
            self.known.clear()
            self.spaced.clear()
        known, spaced = self.known, self.spaced

        def parts(text: str) -> tuple[list[str], list[str]]:
            """Matches of the pattern at the beginning, and the pieces after a lone space each."""
            pieces = [text] if _DOUBLE_SPACE.search(text) else text.split(" ")
            return self.split.findall(pieces[0]), pieces[1:]

        words: set[str] = set()
        new: set[str] = set()
        for text in texts:  # split twice rather than kept: a block has millions of pieces, few of them new
            first, pieces = parts(text)
            words.update(first)
            new.update(x for x in pieces if x not in spaced)
        found = {x: self.split.findall(" " + x) for x in new}
        words.update(w for match in found.values() for w in match)
        self.encode_words(words)
        spaced.update((x, b"".join([known[w] for w in match])) for x, match in found.items())
        out = []
        for text in texts:
            first, pieces = parts(text)
            out.append(b"".join([*[known[w] for w in first], *[spaced[x] for x in pieces]]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _lists(packed: list[bytes]) -> pa.Array:
    lengths = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _blocks(column: pa.Array, limit: int = 1 << 24) -> Iterator[tuple[int, list[str]]]:
    """Texts in blocks of about ``limit`` characters."""
    texts, size, start = [], 0, 0
    for i, x in enumerate(column):
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size > limit:
            yield start, texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield start, texts


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            for start, texts in _blocks(batch.column("text")):
                packed = vocabulary.encode_block(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)).cast(pa.int64()), _lists(packed)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` (bytes) of rows with ids; ids that the vocabulary lacks raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            texts = [vocabulary.decode(np.array(x.as_py() or [], np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: decode(encode(documents)) in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            for start, texts in _blocks(batch.column("text")):
                packed = vocabulary.encode_block(texts)
                decoded = [vocabulary.decode(np.frombuffer(x, np.uint32)) for x in packed]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)).cast(pa.int64()), _lists(packed), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
