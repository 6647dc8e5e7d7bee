"""Operator 4: secret scans, three fixed rules and a character convolutional network over further candidates.

The rules find assignments, access keys and long hexadecimal runs. Of every run of key characters the parts outside
the rules' spans are candidates if they have at least ``CANDIDATE`` characters, with or without digits. The network sees all
of a candidate: in one window up to 56 characters, else in windows of 56 that overlap by half, whose highest score
counts; and 24 characters before and 16 after each window (whole texts are scanned, at any place). It is one convolution
of width 5 over character classes, the maximum and mean of each filter, and a logistic output, all in numpy.

It is trained on labelled findings: at most ``TRAIN_ROWS`` documents (those with the smallest hash of doc_id) give the
rules' findings as positives and other candidates as negatives, of which those with the smallest hash are used
(4 windows a document); ``EXAMPLES`` generated findings of common key
formats and look-alikes (identifiers, paths, versions, addresses) with a fixed seed join them. A held-out fifth
calibrates the scores (logistic scaling) and sets the threshold: one half, or less where that is needed to keep at
least ``RECALL`` of the held-out secrets.

A null or empty text has no span. Very long texts are scanned whole, runs of any length window by window. Spans that start
together stand in the order of the kinds. Repeated rows give a row each; an empty table gives an empty result. ``scan`` ignores further columns,
``redact`` passes them on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 1000
EXAMPLES = 3000
RECALL = 0.95
CANDIDATE = 20
KINDS = ("assign", "access", "hex", "cnn")
# The patterns of the three rules.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
BEFORE, HEAD, TAIL, AFTER = 24, 40, 16, 16
WIDTH = BEFORE + HEAD + TAIL + AFTER
SEEN = HEAD + TAIL
CHANNELS, FILTERS, KERNEL = 12, 24, 5
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of runs outside the rules' spans, of at least ``CANDIDATE`` characters."""
    out = []
    first = 0  # of the spans that may still reach a run
    spans = _merged([(a, b) for a, _, b in base])
    for m in RUN.finditer(text):
        at = m.start()
        while first < len(spans) and spans[first][1] <= at:
            first += 1
        for a, b in spans[first:]:
            if a >= m.end():
                break
            if a - at >= CANDIDATE:
                out.append((at, a))
            at = max(at, b)
        if m.end() - at >= CANDIDATE:
            out.append((at, m.end()))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping pieces of a run that a window shows in full; they cover it."""
    if end - start <= SEEN:
        return [(start, end)]
    return [(a, a + SEEN) for a in [*range(start, end - SEEN, SEEN // 2), end - SEEN]]


def _class_table() -> np.ndarray:
    table = np.full(256, 10, np.uint8)
    for i, group in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/", "=", "-_", ".", "\"'`", ":;,()[]{}<>|&?!#$%@*~^\\")):
        for c in group:
            table[ord(c)] = i
    return table


_CLASSES = _class_table()


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the characters around a piece; 255 is padding. The last channel marks the piece itself."""
    head = text[start : min(end, start + HEAD)]
    tail = text[start + HEAD : end]
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), head.ljust(HEAD, "\0"), tail.ljust(TAIL, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    codes = np.array([ord(c) for c in "".join(parts)])
    return np.where(codes == 0, 255, _CLASSES[np.minimum(codes, 255)]).astype(np.uint8)


def _input(windows: np.ndarray) -> np.ndarray:
    x = (windows[:, :, None] == np.arange(CHANNELS)[None, None, :]).astype(np.float32)
    x[:, BEFORE : BEFORE + HEAD + TAIL, CHANNELS - 1] = windows[:, BEFORE : BEFORE + HEAD + TAIL] != 255
    return x


def _patches(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:, k : WIDTH - KERNEL + 1 + k] for k in range(KERNEL)], axis=2)


class Network:
    """Weights, and the calibration and threshold of its scores."""

    def __init__(self, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.conv = random.normal(0, 0.15, (KERNEL * CHANNELS, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def forward(self, windows: np.ndarray):
        p = _patches(_input(windows))
        h = np.maximum(p @ self.conv + self.shift, 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return p, h, pooled, pooled @ self.out + self.bias[0]

    def score(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(windows):
            return np.zeros(0)
        z = np.concatenate([self.forward(windows[i : i + 512])[3] for i in range(0, len(windows), 512)]).astype(float)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -35, 35)))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.004, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        order = random.permutation(len(labels))
        held, used = order[: len(order) // 5], order[len(order) // 5 :]
        weights = [self.conv, self.shift, self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            random.shuffle(used)
            for i in range(0, len(used), 64):
                rows = used[i : i + 64]
                p, h, pooled, z = self.forward(windows[rows])
                g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[rows]) / len(rows)
                g_pool = g[:, None] * self.out
                g_h = np.repeat(g_pool[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(g_h, (top := h.argmax(axis=1)[:, None, :]), np.take_along_axis(g_h, top, 1) + g_pool[:, None, :FILTERS], 1)
                g_h *= h > 0
                grads = [p.reshape(-1, p.shape[2]).T @ g_h.reshape(-1, FILTERS), g_h.sum(axis=(0, 1)), pooled.T @ g, np.array([g.sum()])]
                step += 1
                for w, d, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        z, y = self.forward(windows[held])[3].astype(float), labels[held].astype(float)
        for _ in range(200):  # logistic scaling of the held-out scores
            q = 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -35, 35)))
            self.scale -= 0.1 * float(((q - y) * z).mean())
            self.offset -= 0.1 * float((q - y).mean())
        found = np.sort(self.score(windows[held])[y > 0])
        if len(found):
            self.threshold = min(0.5, float(found[int((1 - RECALL) * len(found))]))


def generated(count: int = EXAMPLES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings of common formats in short contexts, half of them secrets."""
    random = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = lower + upper + digits

    def draw(letters: str, low: int, high: int) -> str:
        return "".join(random.choice(list(letters), int(random.integers(low, high + 1))))

    def words(low: int, high: int, join: str) -> str:
        return join.join(draw(lower, 2, 9) for _ in range(int(random.integers(low, high + 1))))

    secret = (
        lambda: draw(every, 24, 48),
        lambda: draw(every + "+/", 30, 60) + "=" * int(random.integers(0, 3)),
        lambda: draw(lower, 2, 4) + "_" + draw(lower, 3, 5) + "_" + draw(every, 20, 40),
        lambda: draw(upper, 4, 4) + draw(upper + digits, 20, 28),
        lambda: draw(every, 20, 40) + "-" + draw(every, 8, 16),
        lambda: draw("0123456789ABCDEF", 32, 64),
        lambda: draw(lower + upper, 24, 48),
    )
    plain = (
        lambda: words(3, 5, "_") + str(random.integers(1, 99)),
        lambda: words(2, 4, "-") + "-" + str(random.integers(1900, 2030)),
        lambda: "/" + words(3, 5, "/") + str(random.integers(0, 9)),
        lambda: draw(lower, 4, 8) + "-" + "-".join(draw(digits, 1, 4) for _ in range(6)),
        lambda: words(3, 5, "").title() + words(2, 3, "").title() + str(random.integers(1, 9)),
        lambda: "=" * int(random.integers(18, 40)) + draw(lower, 1, 3) + draw(digits, 1, 2),
        lambda: draw(lower, 20, 30) + str(random.integers(0, 999)),
        lambda: words(4, 7, ("_", "-", "/")[int(random.integers(3))]),
        lambda: words(4, 6, " ").title().replace(" ", ""),
        lambda: "-_=/+"[int(random.integers(5))] * int(random.integers(20, 80)),
        lambda: draw(lower, 20, 40),
        lambda: "/" + words(9, 16, "/"),
    )
    keys = ("key", "auth", "credential", "bearer", "pwd", "access", "client")
    rows, labels = [], []
    for i in range(count):
        is_secret = i % 2
        maker = (secret if is_secret else plain)[int(random.integers(len(secret if is_secret else plain)))]
        run = maker()
        if not RUN.fullmatch(run):
            continue
        named = random.random() < (0.5 if is_secret else 0.1)
        lead = words(1, 4, " ") + (f" {keys[int(random.integers(len(keys)))]} = \"" if named else " ")
        key = (len(lead), len(lead) + len(run))
        if is_secret and random.random() < 0.25:  # a key inside a long path
            path = "/" + words(1, 10, "/") + "/"
            key = (key[0] + len(path), key[1] + len(path))
            run = path + run + "/" + words(1, 10, "/")
        text = lead + run + ("\" " if named else " ") + words(1, 3, " ")
        for a, b in pieces(len(lead), len(lead) + len(run)):
            shown = min(b, key[1]) - max(a, key[0])
            if is_secret and 0 < shown < CANDIDATE:
                continue  # too little of the key to tell
            rows.append(window(text, a, b))
            labels.append(int(is_secret and shown > 0))
    return np.stack(rows), np.array(labels)


def train(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> Network:
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).distinct()
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most train_rows numbers

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                for a, kind, b in base:
                    if kind == 0:
                        a = b - len(ASSIGN.match(text, a, b)[1])
                    for piece in pieces(a, b):
                        rows.append(window(text, *piece).tobytes())
                        labels.append(1)
                for a, b in candidates(text, base):
                    for piece in pieces(a, b):
                        rows.append(window(text, *piece).tobytes())
                        labels.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.int32())], ["seen", "label"])

    # The same windows occur in copies; the bound holds for distinct ones.
    found = sample.mapInArrow(label, "seen binary, label int").groupBy("seen").agg(F.max("label").alias("label")).orderBy(F.xxhash64("seen"), "seen").limit(4 * train_rows).collect()
    windows, labels = generated()
    if found:
        windows = np.concatenate([windows, np.stack([np.frombuffer(r["seen"], np.uint8) for r in found])])
        labels = np.concatenate([labels, np.array([r["label"] for r in found])])
    network = Network()
    network.fit(windows, labels)
    return network


def found_by_network(network: Network, texts: list[str], bases: list[list[Span]]) -> Iterator[tuple[int, int, int, float]]:
    """``row, start, end, score`` of the candidates whose highest score reaches the threshold."""
    places, windows = [], []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for a, b in candidates(text, base):
            seen = [window(text, *piece) for piece in pieces(a, b)]
            places.append((i, a, b, len(windows)))
            windows += seen
    if places:
        highest = np.maximum.reduceat(network.score(np.stack(windows)), [at for *_, at in places])
        for (i, a, b, _), score in zip(places, highest.tolist(), strict=True):
            if score >= network.threshold:
                yield i, a, b, score


def scan(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, spans`` of each row; spans: array of (start, end, kind, score), by start and kind."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, train_rows))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            bases = [base_spans(text) for text in texts]
            all_spans: list[list[tuple]] = [[(a, kind, b, 1.0) for a, kind, b in base] for base in bases]
            for i, a, b, score in found_by_network(network, texts, bases):
                all_spans[i].append((a, 3, b, score))
            rows = [[{"start": a, "end": b, "kind": KINDS[kind], "score": s} for a, kind, b, s in sorted(spans)] for spans in all_spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(rows, spans_type)], ["doc_id", "text", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, spans array<struct<start: long, end: long, kind: string, score: double>>")


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal stretch of spans replaced."""
    out, at = [], 0
    end = -1
    for a, b in sorted(spans):
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[max(end, 0) :]


def redact(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``documents`` with every span of a secret replaced in ``text``; other columns and all rows stay."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, train_rows))
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            bases = [base_spans(text or "") for text in texts]
            spans = [[(a, b) for a, _, b in base] for base in bases]
            for i, a, b, _ in found_by_network(network, [text or "" for text in texts], bases):
                spans[i].append((a, b))
            texts = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return documents.mapInArrow(run, documents.schema)
