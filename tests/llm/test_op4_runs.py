"""The network is asked about all of every run."""

import random

import numpy as np

from evidentia.llm import op4_secrets as S

KEY = "Zk3vQ9xLm2Tn8RbY5cWd7HgJ4pSa6UeF"


def test_pieces_and_windows_show_every_character():
    for length in (20, 56, 57, 84, 85, 300):
        assert {i for a, b in S.pieces(7, 7 + length) for i in range(a, b)} == set(range(7, 7 + length))
        assert all(b - a <= S.SEEN for a, b in S.pieces(7, 7 + length))
    long = "/".join(["abcdefg"] * 12)
    text = long + "/" + KEY + "/" + long
    shown = [S.window(text, a, b)[S.BEFORE : S.BEFORE + S.SEEN].tobytes() for a, b in S.pieces(0, len(text))]
    at = text.index(KEY)
    assert any(S.window(text, at, at + len(KEY))[S.BEFORE : S.BEFORE + 28].tobytes() in x for x in shown)


def test_candidates_are_what_the_rules_leave():
    rng = random.Random(1)
    texts = ["0123456789abcdef" * 2 + "-" + KEY, "AbCdEfGhIjKlMnOpQrStUvWxYz", "/" * 25 + " x"]
    texts += ["".join(rng.choice(["a", "F", "-", " ", KEY[:22], "0123456789abcdef" * 2, "token=abcdefg1"]) for _ in range(12)) for _ in range(200)]
    for text in texts:
        base = S.base_spans(text)
        free = [True] * len(text)
        for a, _, b in base:
            free[a:b] = [False] * (b - a)
        expected = []
        for m in S.RUN.finditer(text):
            at = m.start()
            for i in range(m.start(), m.end() + 1):
                if i == m.end() or not free[i]:
                    if i - at >= S.CANDIDATE:
                        expected.append((at, i))
                    at = i + 1
        assert S.candidates(text, base) == expected
    assert S.candidates(texts[0], S.base_spans(texts[0])) == [(32, 33 + len(KEY))] and S.candidates(texts[1], []) == [(0, 26)]


def test_keys_in_long_runs_and_beside_rules_are_redacted(spark):
    path = "/usr/local/share/some/long/path/with/many/words/in/it/and/more/words"
    texts = [path + "/" + KEY + path, "see " + "0123456789abcdef" * 2 + "-" + KEY + " there", "bearer = \"qWvZkRtYbNmXcLpJhGfDsAaQwErTyUiOp\" end", path + path]
    found = [r.text for r in S.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert not any(KEY in t for t in found[:2]) and "qWvZk" not in found[2] and found[3] == texts[3]


def test_threshold_keeps_recall_below_one_half():
    """Secrets that look like most plain findings score under one half and must still be kept."""
    windows = np.repeat(np.stack([S.window("x " + KEY + " y", 2, 2 + len(KEY))]), 2000, axis=0)
    labels = (np.arange(2000) % 4 == 0).astype(int)
    network = S.Network()
    network.fit(windows, labels, epochs=2)
    assert network.threshold < 0.5 and (network.score(windows) >= network.threshold).mean() >= S.RECALL
