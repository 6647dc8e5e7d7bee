"""Operator 12: embedding whitening from exact integer moments.

Components are quantised to integers x = floor(scale * c) + shift. The sums S and the products G = X'X of all vectors are exact:

1. Digit-slice GEMM: a block of rows is cut into balanced digits of 16 bits; float64 BLAS products of two digit
   matrices stay below 2**53, so that each is exact. Products of the same weight are added up in 64-bit integers.
2. The weights are recombined to big integers, a row of G at a time, and travel as bytes.
3. Rows of G of all tasks are merged by their number: a task streams past them and holds one row of G.
4. V = (n G - S S') / n**2 is formed in integers (so it is centred before anything is rounded) and decomposed by
   cyclic Jacobi rotations in extended precision, which keep the small eigenvalues of badly scaled data right; above ``JACOBI``
   dimensions by the LAPACK driver in double precision.

What the driver holds is S, G and the components: a size given by the dimensions, whatever the number of rows. The covariance
of the whitened vectors is measured on all of them in a second pass, by merging centred moments.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of another length than the most frequent one
(ties: the longest) can't be fitted together and take no part either. Integers beyond 62 bits are clipped there. Repeated rows and ids
count and are returned each; a null id is returned as null. Directions without variance (an eigenvalue below 1e-14 of the largest, as of constant
dimensions or fewer vectors than dimensions) can't be scaled and are not returned. Equal eigenvalues leave the choice of their components
free; one choice holds for all rows. An empty table gives an empty result; further columns are ignored. Long vectors are cut in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import tasks

#: Bits of a digit, rows of a block (at most; numbers of a block), and dimensions up to which Jacobi rotations are used.
DIGIT, ROWS, NUMBERS, JACOBI = 16, 8192, 1 << 20, 256
#: Blocks whose products are added up in 64 bits before they are recombined: 2**30 * ROWS * digits * FOLD < 2**63.
FOLD = 1 << 16
LIMIT = 2.0**62


def integers(column: pa.Array, dims: int, scale: float, shift: int) -> np.ndarray:
    """The quantised rows of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -LIMIT, LIMIT - 1024).astype(np.int64).reshape(-1, dims) + shift


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(ROWS, NUMBERS // dims))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Balanced digits, lowest first, as float64: x = sum of digit * 2**(DIGIT * place), each within 2**(DIGIT - 1)."""
    out, half = [], 1 << (DIGIT - 1)
    while x.any():
        low = ((x + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> DIGIT
    return out


class Moments:
    """n, S and the upper triangle of G of the rows added, exact."""

    def __init__(self, dims: int) -> None:
        self.n, self.blocks = 0, 0
        self.sums: dict[int, np.ndarray] = {}  # by place of the digit
        self.products: dict[int, np.ndarray] = {}  # by the sum of two places
        self.total, self.gram = np.zeros(dims, object), np.zeros((dims, dims), object)

    def add(self, x: np.ndarray) -> None:
        parts = digits(x)
        for i, a in enumerate(parts):
            self.sums[i] = self.sums.get(i, 0) + a.sum(axis=0).astype(np.int64)
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64)
                self.products[i + j] = self.products.get(i + j, 0) + (product if i == j else product + product.T)
        self.n += len(x)
        self.blocks += 1
        if self.blocks % FOLD == 0:
            self.fold()

    def fold(self) -> None:
        """Recombines the digits to big integers."""
        for place, s in self.sums.items():
            self.total = self.total + s.astype(object) * (1 << DIGIT * place)
        for place, p in self.products.items():
            self.gram = self.gram + p.astype(object) * (1 << DIGIT * place)
        self.sums, self.products = {}, {}

    def rows(self) -> Iterator[tuple[int, list[int]]]:
        """Row 0: n and S; row i + 1: G[i, i:]."""
        self.fold()
        yield 0, [self.n, *self.total.tolist()]
        for i in range(len(self.total)):
            yield i + 1, self.gram[i, i:].tolist()


def packed(values: list[int]) -> bytes:
    """Big integers as bytes: their common width, then each in two's complement."""
    width = max((v.bit_length() for v in values), default=0) // 8 + 1
    return width.to_bytes(4, "little") + b"".join(v.to_bytes(width, "little", signed=True) for v in values)


def unpacked(blob: bytes) -> list[int]:
    width = int.from_bytes(blob[:4], "little")
    return [int.from_bytes(blob[i : i + width], "little", signed=True) for i in range(4, len(blob), width)]


def moments(vectors: DataFrame, dims: int, scale: float, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the rows of the upper triangle of G over ``vectors(embedding)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(dims)
        for block in blocks(batches, dims):
            found.add(integers(block.column("embedding"), dims, scale, shift))
        if found.n:
            for i, values in found.rows():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), T.blob_array([packed(values)])], ["i", "row"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), T.blob_array([packed(held)])], ["i", "row"])

        for batch in batches:
            for i, blob in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                values = unpacked(blob.as_py())
                if i == key:
                    held = [a + b for a, b in zip(held, values, strict=True)]
                    continue
                if key is not None:
                    yield done()
                key, held = i, values
        if key is not None:
            yield done()

    parts = vectors.select("embedding").mapInArrow(partial, "i int, row binary").repartition(tasks(vectors.sparkSession), "i").sortWithinPartitions("i")
    got = {r["i"]: unpacked(r["row"]) for r in parts.mapInArrow(merge, "i int, row binary").collect()}  # dims + 1 rows
    if not got:
        return 0, [], []
    return got[0][0], got[0][1:], [got[i + 1] for i in range(dims)]


def _extended(value: int) -> np.longdouble:
    """An integer to the nearest extended number (about), in steps of 48 bits."""
    out, sign = np.longdouble(0), -1 if value < 0 else 1
    value = abs(value)
    drop = max(0, value.bit_length() - 96)
    value >>= drop
    out = np.ldexp(np.longdouble(value >> 48), 48) + np.longdouble(value & ((1 << 48) - 1))
    return np.ldexp(out, drop) * sign


def jacobi(matrix: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a positive semidefinite matrix, by rotations in its own precision.

    A rotation is done while an entry is large against its own two diagonal entries, so that small eigenvalues are as precise as large ones.
    """
    a, d = matrix.copy(), len(matrix)
    q = np.eye(d, dtype=a.dtype)
    small = np.finfo(a.dtype).eps * 4
    for _ in range(sweeps):
        rotated = False
        for i in range(d - 1):
            for j in (np.flatnonzero(np.abs(a[i, i + 1 :]) > small * np.sqrt(np.abs(a[i, i] * a.diagonal()[i + 1 :]))) + i + 1).tolist():
                if not abs(a[i, j]) > small * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                rotated = True
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                p, r = a[i, i] - t * a[i, j], a[j, j] + t * a[i, j]
                x, y = a[i].copy(), a[j].copy()
                a[i], a[j] = c * x - s * y, s * x + c * y
                a[:, i], a[:, j] = a[i], a[j]
                a[i, i], a[j, j], a[i, j], a[j, i] = p, r, 0, 0
                x, y = q[:, i].copy(), q[:, j].copy()
                q[:, i], q[:, j] = c * x - s * y, s * x + c * y
        if not rotated:
            break
    return a.diagonal().copy(), q


def decompose(n: int, total: list[int], gram: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), components (columns) and the trace of V, from exact moments."""
    d = len(total)
    square = _extended(n * n)
    v = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = _extended(n * gram[i][j - i] - total[i] * total[j]) / square
    trace = float(sum(n * gram[i][0] - total[i] * total[i] for i in range(d)) / (n * n))
    if d <= JACOBI:
        values, vectors = jacobi(v)
    else:
        values, vectors = np.linalg.eigh(v.astype(np.float64))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(float(values.max()), 0.0) * 1e-14] if d else order
    vectors = vectors[:, order]
    # Either sign would do: the largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return values[order].astype(np.float64), vectors.astype(np.float64), trace


class Fit:
    """What rows are whitened with: n, S, components, eigenvalues and the trace."""

    def __init__(self, n: int, total: list[int], gram: list[list[int]], components: int, scale: float, shift: int) -> None:
        self.n, self.total, self.dims, self.scale, self.shift = n, total, len(total), scale, shift
        self.values, self.vectors, self.trace = decompose(n, total, gram, components) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
        # x - S/n = (x - base) - rest/n, base and rest exact integers with 0 <= rest < n.
        self.base = np.array([min(max(t // n, -(1 << 62)), 1 << 62) for t in total], np.int64) if n else np.zeros(0, np.int64)
        self.rest = [t - n * int(b) for t, b in zip(total, self.base.tolist(), strict=True)]
        self.directions = self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return ((x - self.base).astype(np.float64) - mean) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - S)**2 of the rows: in 64 bits while nothing can pass them, else in big integers."""
        near = x - self.base
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n + max(map(abs, self.rest), default=0)
        if most * most * self.dims < 1 << 63:
            return ((near * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        return ((near.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()


def identity_error(vectors: DataFrame, fit: Fit, fitted) -> float:
    """The largest entry of the covariance of the whitened vectors minus the identity: centred moments of each task, merged pair by pair."""
    k = fit.vectors.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray, np.ndarray] | None = None
        for block in blocks(batches, fitted.value.dims):
            held = merged(held, centred(fitted.value.whitened(integers(block.column("embedding"), fitted.value.dims, fitted.value.scale, fitted.value.shift))))
        if held is not None:
            for i in range(k):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([held[0]], pa.int64()), T.blob_array([held[1].tobytes()]), T.blob_array([held[2][i].tobytes()])], ["i", "n", "mean", "row"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, worst = None, None, 0.0

        def error() -> float:
            one = np.zeros(k)
            one[key] = 1
            return float(np.abs(held[2] / held[0] - one).max())

        for batch in batches:
            for i, n, mean, row in zip(batch.column("i").to_pylist(), batch.column("n").to_pylist(), batch.column("mean"), batch.column("row"), strict=True):
                if i != key and key is not None:
                    worst, held = max(worst, error()), None
                key, at = i, i
                new = (n, np.frombuffer(mean.as_py()), np.frombuffer(row.as_py()))
                if held is None:
                    held = new
                    continue
                total, gap = held[0] + n, new[1] - held[1]
                held = (total, held[1] + gap * (n / total), held[2] + new[2] + gap * gap[at] * (held[0] * n / total))
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([max(worst, error())])], ["worst"])

    if not k:
        return 0.0
    rows = vectors.select("embedding").mapInArrow(partial, "i int, n long, mean binary, row binary").repartition(tasks(vectors.sparkSession), "i").sortWithinPartitions("i")
    return float(rows.mapInArrow(merge, "worst double").agg(F.max("worst")).first()[0])


def centred(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error``, a row a component.

    A deviation of more than 38 digits is null.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = usable.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    usable = usable.where(F.size("embedding") == dims)
    fit = Fit(*moments(usable, dims, scale, shift), components, scale, shift)
    fitted = spark.sparkContext.broadcast(fit)  # dims * components numbers
    worst = identity_error(usable, fit, fitted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = fitted.value
        k, limit = len(fit.values), 10**38
        explained = fit.values / fit.trace if k else np.zeros(0)
        for block in blocks(batches, fit.dims):
            if not k:
                continue
            x = integers(block.column("embedding"), fit.dims, fit.scale, fit.shift)
            deviation = pa.array([str(v) if v < limit else None for v in fit.deviations(x)], pa.string()).cast(pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fit.n)), deviation.take(each), pa.array(fit.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, worst))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(rows, schema)
