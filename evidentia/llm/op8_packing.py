"""Operator 8: packing of tokenised documents into sequences, best fit and then swap-based local search.

A document is its token ids and a closing id. Only a document longer than a sequence is cut, from its end, so
that just the first piece may be short. Pieces of full length are sequences of their own; all others are
dealt at random to blocks of about ``BLOCK`` pieces, and each block is packed in one task: best fit of the
pieces by falling length, then a local search between all underfull bins that moves a piece, exchanges one for one or
two for one, as long as that makes the sum of squared fills grow, until bins empty. A block wastes less than one
bin beyond what its sizes allow, that is a sequence in ten thousand.

Null and empty texts are the closing id alone; very long ones are cut whole, none is shortened. Repeated rows are packed each; pieces of
equal length go by doc_id, piece and checksum; an empty table gives an empty result; further columns, of any name, are ignored.
The tokenizer file is read on the executors; the driver sees one number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Pieces that one task packs, about.
BLOCK = 20_000
_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file. Its merges must stand in the order of their ids."""
    if (path, pattern) not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # Byte-level vocabularies write bytes as printable characters: themselves, or from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in file["model"]["vocab"].items() if k not in special}
        merged = [file["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges of this file do not follow its ids")
        _ENCODERS[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path, pattern]


def cut(ids: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Start and length of each piece."""
    head = len(ids) % limit or limit
    return [(0, head), *((i, limit) for i in range(head, len(ids), limit))]


def pieces(documents: DataFrame, path: str, pattern: str, limit: int, closing: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path, pattern)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encoding.encode(text.as_py() or "", allowed_special="all"), closing], "<u4")
                for k, (start, length) in enumerate(cut(ids, limit)):
                    rows.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= size
        else:
            b, room = len(bins), limit - size
            bins.append([i])
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Exchanges between underfull bins, each of which raises the sum of squared fills, until none is left.

    A bin takes an item from another one, for nothing (a move), for one of its items or for two, such that its fill grows by as
    much as its room allows and passes what the other had. Small items so gather in few bins, until those are empty.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    holders: dict[int, dict[int, list[int]]] = {}  # by length and bin: the items of underfull bins

    def put(b: int, i: int) -> None:
        holders.setdefault(lengths[i], {}).setdefault(b, []).append(i)

    def take(b: int, i: int) -> None:
        mine = holders[lengths[i]]
        mine[b].remove(i)
        if not mine[b]:
            del mine[b]

    open_bins = [b for b in range(len(bins)) if fill[b] < limit]
    for b in open_bins:
        for i in bins[b]:
            put(b, i)

    def grown(b: int) -> bool:
        """One exchange that fills b best, from the emptiest bin that allows it."""
        room = limit - fill[b]
        gives: dict[int, tuple[int, ...]] = {}
        for at, y in enumerate(bins[b]):
            gives.setdefault(lengths[y], (y,))
            for z in bins[b][at + 1 :]:
                gives.setdefault(lengths[y] + lengths[z], (y, z))
        for more in range(room, 0, -1):
            for size, back in ((0, ()), *gives.items()):
                owners = holders.get(size + more)
                low = min((o for o in owners if o != b and fill[o] < fill[b] + more), key=lambda o: (fill[o], o), default=None) if owners else None
                if low is None:
                    continue
                x = holders[size + more][low][0]
                for i, source, to in ((x, low, b), *((y, b, low) for y in back)):
                    take(source, i)
                    bins[source].remove(i)
                    bins[to].append(i)
                    put(to, i)
                fill[b] += more
                fill[low] -= more
                return True
        return False

    gained = True
    while gained:  # each exchange raises a bounded sum of integers
        gained = False
        for b in sorted(open_bins, key=lambda b: (-fill[b], b)):
            while bins[b] and fill[b] < limit and grown(b):
                gained = True
        for b in open_bins:
            if fill[b] == limit:
                for i in bins[b]:
                    take(b, i)
        open_bins = [b for b in open_bins if bins[b] and fill[b] < limit]
    return [b for b in bins if b]


def pack(documents: DataFrame, path: str, pattern: str, limit: int = 1024, closing: int = 2, block: int = BLOCK) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut_up = written(pieces(documents, path, pattern, limit, closing), "pieces")
    short = cut_up.where(F.col("length") < limit)
    blocks = max(1, -(-short.count() // block))
    number = F.monotonically_increasing_id()  # of a row of a written table
    full = cut_up.where(F.col("length") == limit).withColumn("sequence_id", -1 - number).withColumn("offset", F.lit(0).cast("long"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        name = table.column("block")[0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, items in enumerate(local_search(best_fit(lengths, limit), lengths, limit)):
            at = 0
            for i in items:
                sequence[i], offset[i] = name + k, at
                at += lengths[i]
        return table.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = short.withColumn("block", F.pmod(F.xxhash64(number), F.lit(blocks)))
    result = dealt.groupBy("block").applyInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(result)
