"""The dealt methods themselves: plain versions of each, planted cases, very long words and texts."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import op2_rules, op3_jaccard, op6_quality, op7_language, op8_packing, op9_substring
from evidentia.llm import text as T


def test_word_hashes_tell_long_words_apart():
    rng = random.Random(3)
    blocks = ["".join(rng.choice("abcdef") for _ in range(64)) for _ in range(2)]
    x, y = blocks
    words = ["".join(p) for p in ((x, y, y, x), (y, x, x, y), (x, x, y, y), (y, y, x, x), (x, y, x, y), (y, x, y, x))]
    words += [w * 400 for w in words] + ["a" * n for n in (255, 256, 257, 100_000, 100_001)]
    for seed in (0, 1):
        data, offsets = T.flat_text(pa.array(words))
        starts, ends, _ = T.word_spans(data, offsets)
        assert len(set(T.word_hashes(data, starts, ends, seed).tolist())) == len(words)


@pytest.mark.parametrize("length", [256, 1000, 100_000])
def test_long_words_and_lines_through_operators(spark, length):
    rng = random.Random(length)
    x, y = ("".join(rng.choice("abc") for _ in range(64)) for _ in range(2))
    repeat = length // 256
    one, other = ((a + b + b + a) * repeat for a, b in ((x, y), (y, x)))
    head = [f"w{i}" for i in range(15)]
    texts = ["\n".join([one, other]), " ".join(head + [one]), " ".join(head + [other]), " ".join(head), " ".join([one] * 3)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in op2_rules.quality_rules(docs).collect()}
    assert found[0].n_dup_lines == 0 and found[0].n_words == 2 and found[4].n_repeat_words == 0 and found[4].word_chars == 3 * len(one)
    sets = {r.doc_id: r for r in op3_jaccard.jaccard_components(docs).collect()}
    assert [sets[i].n_shingles for i in range(5)] == [1, 12, 12, 11, 1]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in texts)]
    for i in range(5):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                assert sets[i].component_id == sets[j].component_id
    assert sets[0].component_id == 0 and sets[4].component_id == 4
    kept = {r.doc_id: r for r in op9_substring.substring_dedup(docs).collect()}
    assert kept[2].kept == other and kept[2].n_removed == 15 and kept[3].n_removed == 15 and kept[1].n_removed == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    text = " ".join(rng.choice(words) for _ in range(300_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, text[: len(text) // 2], "s"), (3, text, "s")], "doc_id long, text string, source string")
    row = {r.doc_id: r for r in op2_rules.quality_rules(docs).collect()}[1]
    assert row.n_words == len(text.split())
    assert {r.doc_id: r.component_id for r in op3_jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in op9_substring.substring_dedup(docs).collect()}
    assert gone[1][1] == 0 and gone[3][0] == gone[3][1]


def test_op2_planted_bad_host(spark):
    """A host of mostly junk loses its other documents too; hosts with few failures keep theirs."""
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    rows = [(100 * h + i, "short" if i < 5 else good(), f"h{h}") for h in range(20) for i in range(100)]
    rows += [(5000 + i, "short" if i < 85 else good(), "junk") for i in range(100)]
    rows += [(6000 + i, "a b c d e f g h i j k" + " $$$$ ####" * 3 if i < 90 else good(), "signs") for i in range(100)]
    rows += [(7000, "short", "tiny"), (7001, good(), "tiny"), (7002, good(), None)]
    got = {r.doc_id: r for r in op2_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for doc_id, _, host in rows:
        assert got[doc_id].kept == (not got[doc_id].base_failed and host not in ("junk", "signs")), (doc_id, host)
    verdicts = {r.host: r for r in op2_rules.host_verdicts(op2_rules.base_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert verdicts["tiny"].rate_base < 0.5 and verdicts["tiny"].host_ok  # shrunk towards the rest


def test_op2_hosts_that_all_fail_mostly_keep_their_good_documents(spark):
    """No host lies above the others, so none is rejected."""
    rng = random.Random(10)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    rows = [(10 * h + i, "short" if i < 7 else good(), f"h{h}") for h in range(20) for i in range(10)]
    got = op2_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 200 and all(r.kept == (r.doc_id % 10 >= 7) for r in got)


def plain_ftrl(rows, bits, alpha, beta, l1, l2, epochs):
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - (l1 if z[f] > 0 else -l1)) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features, values, label in rows:
            pairs = [*zip(features.tolist(), values.tolist(), strict=True), (1 << bits, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(f) * x for f, x in pairs)))
            steps = [(f, (p - label) * x, weight(f)) for f, x in pairs]
            for f, g, w in steps:
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha * w
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z}


def test_op6_against_plain_ftrl():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        f = rng.choice(64, 8, replace=False)
        rows.append((f, rng.random(8) * 3, int(f.min() < 5)))
    weights, bias = op6_quality.ftrl(rows, 6, 0.3, 1.0, 0.02, 0.1, 3)
    plain = plain_ftrl(rows, 6, 0.3, 1.0, 0.02, 0.1, 3)
    assert abs(bias - plain[64]) < 1e-6
    assert all(abs(weights[f] - plain.get(f, 0.0)) < 1e-5 for f in range(64))


def test_op6_equal_texts_score_equally_anywhere():
    texts = ["", "some words here 12 !!", "x" * 5000, "some words here 12 !!"] + ["filler %d text" % i for i in range(50)] + ["some words here 12 !!", ""]
    f, v, b = op6_quality.grams(pa.array(texts))
    weights = np.random.default_rng(1).normal(size=1 << op6_quality.BITS).astype(np.float32)
    scores = op6_quality.row_scores(f, v, b, weights, 0.1)
    assert scores[1] == scores[3] == scores[54] and scores[0] == scores[55] == op6_quality.logistic(0.1)
    dots = [float((weights[f[i:j]] * v[i:j]).sum()) for i, j in zip(b[:-1], b[1:], strict=True)]
    assert np.allclose(scores, op6_quality.logistic(np.array(dots) + 0.1), atol=1e-9)


def test_op7_against_plain_em():
    """The set that plain expectation-maximisation over all sets of languages likes best is found, with its proportions."""
    from itertools import combinations

    rng = np.random.default_rng(7)
    model = np.maximum(rng.dirichlet(np.full(80, 0.15), 4), 1e-9)
    model /= model.sum(axis=1, keepdims=True)
    mixes = [(1, 0, 0, 0), (0.5, 0.5, 0, 0), (0, 0.3, 0, 0.7), (0.34, 0.33, 0, 0.33), (0.25, 0.25, 0.25, 0.25)]
    counts = np.stack([rng.multinomial(900, np.array(m) @ model) for m in mixes]).astype(np.float32)
    best, share = op7_language.mixture(counts, model, rounds=200)
    for row, b, s in zip(counts, best, share, strict=True):
        found = []
        penalty = np.log(row.sum()) / 2 + 2
        for size in range(1, 5):
            for some in combinations(range(4), size):
                theta = np.full(size, 1 / size)
                for _ in range(400):
                    part = theta[:, None] * model[list(some)]
                    theta = (part / part.sum(axis=0) * row).sum(axis=1) / row.sum()
                found.append(((row * np.log(theta @ model[list(some)])).sum() - (size - 1) * penalty, some, theta))
        _, some, theta = max(found, key=lambda x: x[0])
        assert b == some[int(theta.argmax())] or theta.max() - np.sort(theta)[-2] < 0.02
        assert abs(s - theta.max()) < 0.02


def test_op8_local_search_beats_best_fit():
    lengths = [4, 4, 3, 3, 3, 3]
    assert len(op8_packing.best_fit(lengths, 10)) == 3 and len(op8_packing.local_search(op8_packing.best_fit(lengths, 10), lengths, 10)) == 2
    rng = random.Random(1)
    lengths = [rng.randint(300, 420) for _ in range(2000)]
    first = op8_packing.best_fit(lengths, 1024)
    n = len(first)
    last = op8_packing.local_search(first, lengths, 1024)
    assert len(last) < n
    assert sorted(i for b in last for i in b) == list(range(2000)) and max(sum(lengths[i] for i in b) for b in last) <= 1024


def test_hash_is_the_one_of_the_contract(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    kept = {r.doc_id: hashlib.sha256(r.kept.encode()).hexdigest() for r in op9_substring.substring_dedup(docs).collect()}
    assert kept == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert re.fullmatch("[0-9a-f]{64}", kept[1])
