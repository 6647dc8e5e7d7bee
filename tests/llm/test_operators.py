"""The operators against brute force on small fixtures: nulls, empty and long texts, repeats, ties, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidentia.llm.scratch import written
from evidentia.llm import op2_rules, op3_jaccard, op4_secrets, op5_kdtree, op6_quality, op7_language, op8_packing, op9_substring, op10_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, tokens string"


def fixture(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    texts = []
    for i in range(n):
        if i % 3 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "\n", "!"]) for _ in range(rng.randint(3, 80))))
    texts += ["", "   \n\t ", None, "one", "one two three four", "One two three four", "x " * 3000, "#$% *** &&&", "a\nb\na\n\n", "漢字 ＡＢＣ 😀 é"]
    rows = [(i, t, "en", "src0", 1, "k", 5, "t") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "de", None, 2, None, 1, None), (None, texts[4], None, "src1", None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ident(x):
    return (x is None, x if x is not None else 0)


def test_op2_base_measures(docs, rows, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op2_rules.quality_rules(docs).collect())
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeat = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(words) < 10 or 100 * len(repeat) > 20 * len(words)] += 1
    assert got == expected
    assert op2_rules.quality_rules(none).count() == 0


def test_op2_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good, "a") for i in range(40)] + [(100 + i, bad, "b") for i in range(40)] + [(200, good, "b"), (300, good, None)]
    got = {r.doc_id: r.kept for r in op2_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and got[300] and not got[100] and not got[200]


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for r, g, s in zip(rows, group, sets, strict=True):
        least[g].append(r[0])
    return Counter((r[0], len(s), min((x for x in least[g] if x is not None), default=None) if s else r[0]) for r, g, s in zip(rows, group, sets, strict=True))


@pytest.mark.parametrize("heavy", [2, 128])
def test_op3_components(docs, rows, none, heavy):
    """heavy=2 sends nearly all groups through clusters of blocks."""
    got = Counter(map(tuple, op3_jaccard.jaccard_components(docs, heavy=heavy, block=8).collect()))
    assert got == brute_components(rows)
    assert op3_jaccard.jaccard_components(none).count() == 0


def test_op9_substrings(spark, rows, docs, none):
    size = 6
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in op9_substring.substring_dedup(docs, size=size, bits=12).collect())
    first = {}
    lists = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, lists, strict=True):
        for i in range(len(w) - size + 1):
            if r[0] is not None:
                first[tuple(w[i : i + size])] = min(r[0], first.get(tuple(w[i : i + size]), r[0]))
    expected = Counter()
    for r, w in zip(rows, lists, strict=True):
        gone = {i + k for i in range(len(w) - size + 1) if r[0] is not None and first[tuple(w[i : i + size])] < r[0] for k in range(size)}
        expected[r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == expected
    assert op9_substring.substring_dedup(none, bits=12).count() == 0


def test_op10_equals_tiktoken_and_round_trips(docs, rows, none):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = op10_bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((r[0], tuple(plain.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert op10_bpe.decode(op10_bpe.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN).where("decoded is null").count() == 0
    assert op10_bpe.round_trip(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_op8_pieces_and_sequences(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    got = op8_packing.pack(docs, JSON, public_tokenizers.PATTERN, limit=64, block=20).collect()
    expected = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(op8_packing.cut(ids, 64)):
            expected[r[0], k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert op8_packing.pack(none, JSON, public_tokenizers.PATTERN).count() == 0


def test_op8_local_search_empties_bins():
    lengths = [5, 5, 4, 3, 3]
    assert len(op8_packing.local_search([[0], [1, 2], [3, 4]], lengths, 10)) == 2
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins = op8_packing.local_search([[i] for i in range(300)], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= math.ceil(sum(lengths) / 100) * 1.1


@pytest.mark.parametrize("shard", [16, 1000])
def test_op5_exact(spark, shard):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.2, 8).astype("float32").tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[i % 5][1]) for i in range(60)] + [(400, None), (401, [0.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, vectors[2][1])]
    got = op5_kdtree.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), shard=shard).collect()
    usable = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in usable:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q)
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])}
    assert {tuple(r) for r in got} == expected
    assert op5_kdtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op5_repeated_ids_are_rows_by_themselves(spark):
    """Each row of a repeated id is asked and found, but by itself."""
    vectors = [(20, [1.0, 0.0]), (20, [-1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-2.0, 0.0]), (None, [1.0, 1.0])]
    for k in (1, 20):
        got = op5_kdtree.top_k(spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, row string"), k=k, scale=1.0, shard=2).collect()
        expected = []
        for q, (name, v) in enumerate(vectors[:3]):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for c, (i, w) in enumerate(vectors[:5]) if c != q)
            expected += [(name, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
        assert sorted(map(tuple, got)) == sorted(expected)


def test_op5_queries_stream_in_blocks():
    """A task takes a shard's queries as they come and never holds more than a block of them."""
    rng = np.random.default_rng(5)

    def rows(asks, count):
        vectors = [[float(x) for x in rng.integers(-9, 9, 4)] for _ in range(count)]
        return pa.RecordBatch.from_pydict({"shard": [0] * count, "dims": [4] * count, "asks": [asks] * count, "id": list(range(count)), "row": list(range(count)), "embedding": vectors, "floor": pa.array([None] * count, pa.decimal128(38, 0))})

    taken = []

    def batches():
        for asks, count in ((0, 100), (0, 100), (1, 300), (1, 300), (1, 300)):
            taken.append(count)
            yield rows(asks, count)

    sizes = []
    for out in op5_kdtree.answers(batches(), 3, 1.0, block=128):
        sizes.append((len(taken), len(set(out.column("query_id").to_pylist())), out.num_rows))
    assert sizes == [(n, size, 3 * size) for n in (3, 4, 5) for size in (128, 128, 44)]


def test_op5_small_points_and_large_queries_are_exact(spark):
    rng = random.Random(4)
    vectors = [(i, [float(rng.randint(1, 10**5)) for _ in range(4)]) for i in range(1, 20)] + [(20, [float(rng.randint(2**50, 2**52)) for _ in range(4)])]
    got = op5_kdtree.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=5, scale=1.0, shard=4).collect()
    q = [int(x) for x in vectors[-1][1]]
    scored = sorted((-sum(a * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in vectors[:-1])
    limit = 2**63 - 1
    assert {tuple(r) for r in got} == {(20, n + 1, i, min(-s, limit)) for n, (s, i) in enumerate(scored[:5])}


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_op4_base_spans_stay_and_more_are_found(spark, none):
    texts = [None, "", "é token = \"abcdef12\" x", "secret=token = abcdefgh", "PassWord:'12345' api_key=1234567", "AKIA" + "A1" * 8 + " AKIAB", "f" * 24 + " " + "0" * 23]
    texts += ["the auth key = \"Zk3vQ9xLm2Tn8RbY5cWd7HgJ4pSa6UeF\" is used", "plain words only in this text", "some-long-page-name-2024-about-things"]
    found = {r.doc_id: r.spans for r in op4_secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, op4_secrets.KINDS.index(s.kind), s.end) for s in found[i] if s.kind != "cnn"] == brute_spans(t or "")
    assert any(s.kind == "cnn" for s in found[7]) and not found[8] and not found[9]
    assert op4_secrets.scan(none).count() == 0
    assert op4_secrets.redacted("ab token=secret1 c", [(3, 16), (9, 16)]) == "ab [SECRET] c"


def test_op4_network_on_held_out_findings():
    windows, labels = op4_secrets.generated(2000, seed=1)
    network = op4_secrets.Network()
    network.fit(windows, labels)
    windows, labels = op4_secrets.generated(600, seed=99)
    said = network.score(windows) >= network.threshold
    assert said[labels == 1].mean() > 0.9 and said[labels == 0].mean() < 0.1


def test_op6_held_out_accuracy(spark, docs, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = op6_quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels)
    held = got.join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("x"))
    assert held.agg(F.avg("x")).first()[0] > 0.95
    assert op6_quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert op6_quality.quality_scores(none, labels).count() == 0


def test_op7_held_out_accuracy(spark, docs, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op7_language.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select((F.col("lang_pred") == F.col("lang")).cast("int").alias("x")).agg(F.avg("x")).first()[0] > 0.97
    small = {(r.doc_id, r.lang_pred) for r in op7_language.identify(docs).where("lang_pred = 'und'").collect()}
    assert {60, 61, 62, 67} <= {i for i, _ in small}
    assert op7_language.identify(none).count() == 0


def test_op7_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    model = rng.dirichlet(np.full(200, 0.2), 3)
    counts = np.stack([rng.multinomial(400, 0.6 * model[0] + 0.4 * model[1]), rng.multinomial(400, model[2])]).astype(np.float32)
    best, share = op7_language.mixture(counts, np.maximum(model, 1e-9))
    assert best.tolist() == [0, 2] and 0.45 < share[0] < 0.75 and share[1] == 1.0


def test_hash_of_op10_query_is_plain(spark):
    from evidentia.llm.queries import QUERIES

    row = QUERIES["op10_byte_bpe"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
