"""Toxicity, whitening and phrase mining against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import op11_toxicity, op12_whitening, op13_phrases, queries

DOCS = "doc_id long, text string, lang string, source string, n long, score double, phrase string, gram string"


def rows_of(texts):
    return [(i, t, lang, "s", 1, 0.5, "p", "g") for i, (t, lang) in enumerate(texts)]


# --- toxicity


def test_folding():
    assert op11_toxicity.folded("Yоu ÌD10T, st@nd-up 4 $$$ stupid### ﬁne") == " you idiot stand up stupid fine "  # a Cyrillic о, a ligature
    assert op11_toxicity.folded("") == op11_toxicity.folded(" 12 !? ") == " "


def test_matches_heaviest_entry_and_exceptions():
    lexicon = op11_toxicity.Lexicon({" clown": 2.0, " clowni": 3.0, " ass ": 1.0}, frozenset({" clown fish "}))
    assert lexicon.matches(" a clown and clowning ass assess ") == {2: 2.0, 12: 3.0, 21: 1.0}
    assert lexicon.matches(" the clown fish and a clown ") == {21: 2.0}
    assert op11_toxicity.Lexicon({}).matches(" clown ") == {}


def brute_matches(text, entries, exceptions):
    words = text.split()
    weights = [max([w for e, w in entries.items() if (f" {x} " if e.endswith(" ") else f" {x}").startswith(e) and (not e.endswith(" ") or e == f" {x} ")], default=0.0) for x in words]
    for i in range(len(words) - 1):
        if f" {words[i]} {words[i + 1]} " in exceptions:
            weights[i] = weights[i + 1] = 0.0
    return sorted(w for w in weights if w)


def test_automaton_equals_plain_search():
    rng = np.random.default_rng(3)
    syllables = ["ba", "bo", "ca", "co", "da"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(400)]
    entries = {" ba": 1.0, " babo": 2.5, " coda ": 3.0, " cacada": 1.5}
    exceptions = frozenset({" babo da ", " coda ba "})
    text = f" {' '.join(words)} "
    assert sorted(op11_toxicity.Lexicon(entries, exceptions).matches(text).values()) == brute_matches(text, entries, exceptions)


@pytest.fixture(scope="module")
def talk(spark):
    """300 texts; toxic ones hold slurs, some of them in disguise; 'clown fish' is harmless."""
    rng = np.random.default_rng(7)
    common = ["the", "river", "market", "runs", "over", "green", "stone", "and", "of", "house", "garden", "letter"]
    rows, marks = [], []
    for i in range(300):
        words = rng.choice(common, 60).tolist()
        toxic = int(i % 4 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(int(rng.integers(len(words))), str(rng.choice(["idiot", "clown", "1d10t", "іdiot"])))
        if not toxic and i % 15 == 0:
            words.insert(5, "clown fish")
        rows.append((i, " ".join(words), "en", "s", 1, 0.5, "p", "g"))
        marks.append((i, 1, toxic))
    rows += [(1000, None, "en", "s", 1, 0.5, "p", "g"), (1001, "", None, None, 1, 0.5, "p", "g"), (None, "you idiot", "en", "s", 1, 0.5, "p", "g"), (1002, "stone " * 50_000 + "idiot", "en", "s", 1, 0.5, "p", "g"), (4, rows[4][1], "de", "s", 1, 0.5, "p", "g")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks + [(None, 0, 1), (77, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_spares(talk):
    docs, labels = talk
    out = op11_toxicity.toxicity(docs, labels).toPandas()
    assert out.columns.tolist() == ["doc_id", "held_out", "score", "predicted", "n_matches"] and len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    known = out[out.doc_id.isin([d for d in range(300)])]
    right = [truth[int(d)] == p for d, p in zip(known.doc_id, known.predicted) if known is not None and int(d) in truth]
    assert np.mean(right) > 0.98
    for d, h in zip(known.doc_id, known.held_out):
        assert h == (zlib.crc32(str(int(d)).encode()) % 3 == 1)
    by = {None if np.isnan(d) else int(d): (s, n) for d, s, n in zip(out.doc_id, out.score, out.n_matches)}
    assert by[1000] == by[1001] and by[1000][1] == 0 and by[1000][0] == out.score.min()
    assert by[None][1] == 1 and by[1002][1] == 1 and by[1002][0] < by[None][0]  # by length
    assert out[out.doc_id == 4].score.nunique() == 1
    spared = [n for d, n in zip(known.doc_id, known.n_matches) if d % 4 and d % 15 == 0]
    assert spared and max(spared) == 0
    lexicon, _, _ = op11_toxicity.train(docs, labels)
    assert " clown fish " in lexicon.exceptions and any(e.startswith(" idiot") for e in lexicon.entries)


def test_toxicity_looks_at_text_alone_and_never_at_held_out_labels(spark, talk):
    docs, labels = talk
    flipped = labels.withColumn("toxic", F.when(op11_toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("other")})
    a, b = (sorted((r.doc_id or -1, r.score) for r in x.collect()) for x in (op11_toxicity.toxicity(docs, labels), op11_toxicity.toxicity(moved, flipped)))
    assert a == b


def test_toxicity_without_rows_or_labels(spark, talk):
    docs, labels = talk
    assert op11_toxicity.toxicity(docs.limit(0), labels).collect() == []
    out = op11_toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and max(r.score for r in out) < 1e-9
    given = op11_toxicity.learn(op11_toxicity.labelled(docs, labels.limit(0)), given={" fool ": 2.0}, exceptions=frozenset({" fool moon "}))
    assert given.matches(" fool fool moon ") == {0: 2.0}


# --- whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int, n string, whitened string"


def plain_whitening(vectors, components):
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    off = np.array([[n * r[j] - s[j] for j in range(d)] for r in x], object)
    v = np.array([[float(Fraction(int(t), n**3)) for t in row] for row in off.T @ off])
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return n, [int((r * r).sum()) for r in off], e[order] / np.trace(v), (off / n).astype(float) @ (q[:, order] / np.sqrt(e[order]))


def test_whitening_equals_fractions(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(120, 6)) * [1, 2, 3, 50, 0.5, 4]).astype(np.float32).tolist()
    rows = [(i, v, 1, 2, "n", "w") for i, v in enumerate(x)] + [(7, x[7], 0, 0, None, None), (None, x[3], 0, 0, None, None)]
    odd = [(900, None, 0, 0, "", ""), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, 0, "", ""), (902, [float("nan")] * 6, 0, 0, "", ""), (903, [float("inf")] * 6, 0, 0, "", ""), (904, [], 0, 0, "", ""), (905, [1.0, 2.0], 0, 0, "", "")]
    out = op12_whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5), components=4).toPandas()
    n, deviations, explained, white = plain_whitening([r[1] for r in rows], 4)
    assert len(out) == len(rows) * 4 and set(out.n) == {n}
    assert not set(out.vec_id.dropna().astype(int)) & {900, 901, 902, 903, 904, 905}
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9)
    signs = {}
    for i, (vec, _, *_) in enumerate(rows):
        got = out[out.vec_id.isna() if vec is None else out.vec_id == vec].sort_values("component", kind="stable")
        assert set(map(int, got.deviation)) == {deviations[i]}
        for k in range(4):
            w = got[got.component == k + 1].whitened.iloc[0]
            signs.setdefault(k, np.sign(w * white[i, k]))
            assert abs(w * signs[k] - white[i, k]) < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9


def test_whitening_of_badly_scaled_and_flat_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * [1e6, 1e3, 1.0, 0, 5.0]
    x[:, 1] += x[:, 0]
    out = op12_whitening.whiten(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert out.component.max() == 4 and out.identity_error.max() < 1e-6  # the constant dimension has no direction
    one = spark.createDataFrame([(1, [3.0, 4.0])] * 3, "vec_id long, embedding array<double>")
    assert op12_whitening.whiten(one).collect() == []
    assert op12_whitening.whiten(one.limit(0)).collect() == []


def test_digit_slices_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 40, (1 << 62) + 1_000_000):
        x = rng.integers(-top, top, size=(50, 4), dtype=np.int64)
        found = op12_whitening.Moments(4)
        found.add(x[:20])
        found.add(x[20:])
        found.fold()
        big = x.astype(object)
        assert (found.gram == big.T @ big).all() and (found.total == big.sum(axis=0)).all()
    values = [0, -1, 1 << 90, -(1 << 90), 127, 128, -128]
    assert op12_whitening.unpacked(op12_whitening.packed(values)) == values


def test_deviations_beyond_64_bits():
    fit = op12_whitening.Fit(10**6, [5 * 10**6 + 3, 7], [[0, 0], [0]], 0, 64.0, 0)
    x = np.array([[1 << 40, 3]])
    assert fit.deviations(x) == [(10**6 * (1 << 40) - 5 * 10**6 - 3) ** 2 + (3 * 10**6 - 7) ** 2]


def test_jacobi_keeps_small_eigenvalues():
    a = np.diag(np.array([1e24, 1.0, 1e-6], np.longdouble))
    a[0, 1] = a[1, 0] = 1e11
    values, vectors = op12_whitening.jacobi(a)
    assert np.allclose(np.sort(values).astype(float), [1e-6, 0.99, 1e24], rtol=1e-12)
    assert np.allclose((vectors.T @ vectors).astype(float), np.eye(3), atol=1e-15)


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    from evidentia.llm import text as T

    def hashed(text):
        data, offsets = T.flat_text(pa.array([text]))
        starts, ends, _ = T.word_spans(data, offsets)
        return T.word_hashes(data, starts, ends)

    alone, near = hashed("a word"), hashed(f"a word {'x' * 500} {'x' * 501}")
    assert near[:2].tolist() == alone.tolist() and near[2] != near[3]


# --- phrases


def plain_phrases(rows, least, top=2000, max_n=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 80 * found[q[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(150):
        words = rng.choice(["new", "york", "city", "Été", "of", "the", "漢字", "a\tb", "x;y", "z\n\nq", "end."], 80, p=[0.15, 0.12, 0.1, 0.08, 0.15, 0.15, 0.05, 0.05, 0.05, 0.05, 0.05]).tolist()
        for j in range(0, 80, 9):
            words[j] = "New York City hall"
        texts.append(("  ".join(words), [None, "en", "en", "de"][i % 4]))
    texts += [(None, "en"), ("", None), (" .,; ", "fr"), ("the " * 2_000, "es"), texts[0], texts[0], ("w" * 100_000 + " v", "en")]
    return texts, spark.createDataFrame(rows_of(texts), DOCS)


@pytest.mark.parametrize("least,top,bits", [(5, 2000, 28), (2, 7, 28), (5, 2000, 5)])  # with 32 cells nearly all grams are written out
def test_phrases_equal_plain_version(prose, least, top, bits):
    texts, docs = prose
    got = op13_phrases.collocations(docs, least=least, top=top, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(texts, least, top)


def test_phrases_of_nothing(prose):
    assert op13_phrases.collocations(prose[1].limit(0)).collect() == []
    assert op13_phrases.collocations(prose[1].where("lang = 'fr'")).collect() == []


def test_phrase_sql_equals_plain_version(prose, tmp_path):
    texts, docs = prose
    documents = docs.toPandas()  # noqa: F841  DuckDB reads it by name
    got = duckdb.sql(queries.OP13_SQL.replace(">= 30", ">= 5")).fetchall()
    assert sorted(got) == plain_phrases(texts, 5)
