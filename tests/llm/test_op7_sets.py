"""The set of languages of a text has no fixed size, and every labelled language is learnt."""

import numpy as np

from evidentia.llm import op7_language


def test_second_language_outside_the_likeliest_four():
    """Five relatives of the first language are each likelier alone than the true second one."""
    rng = np.random.default_rng(1)
    a, b = rng.dirichlet(np.full(400, 0.2), 2)
    relatives = [0.8 * a + 0.2 * rng.dirichlet(np.full(400, 0.2)) for _ in range(5)]
    model = np.maximum(np.stack([a, *relatives, b]), 1e-6)
    model /= model.sum(axis=1, keepdims=True)
    counts = rng.multinomial(600, 0.45 * a + 0.55 * b)[None].astype(np.float32)
    single = counts @ np.log(model).T
    assert (single[0] > single[0, 6]).sum() >= 4
    best, share = op7_language.mixture(counts, model)
    assert best.tolist() == [6] and 0.45 < share[0] < 0.65


def test_six_languages_in_one_text():
    rng = np.random.default_rng(2)
    model = np.maximum(rng.dirichlet(np.full(300, 0.1), 8), 1e-6)
    model /= model.sum(axis=1, keepdims=True)
    weights = np.array([0.2, 0.16, 0.16, 0.16, 0.16, 0.16, 0, 0])
    best, share = op7_language.mixture(rng.multinomial(3000, weights @ model)[None].astype(np.float32), model)
    assert best.tolist() == [0] and 0.17 < share[0] < 0.23


def test_every_language_is_learnt(spark):
    rows = [(i, f"l{i % 600:03d}", f"word{i}") for i in range(6000)]
    names, model = op7_language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(names) == len(model) == 600
