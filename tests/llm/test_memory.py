"""What tasks and the driver hold at once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from evidentia.llm import op3_jaccard, op9_substring


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_op9_windows_of_many_copies():
    """A task in which every window is repeated holds a small part of its texts' windows at a time, and still sends each one."""
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(1000, 9999, 2000)))
    n = 400
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": [text] * n, "mark": pa.array([7] * n, pa.int64())})
    bits, sketch = 12, SimpleNamespace(value=np.full(2 * (1 << 12) // 8, 255, np.uint8))
    sent = []

    def work():
        for out in op9_substring.candidates(iter([batch]), 13, bits, sketch, 8):
            found = out.to_pylist()
            sent.append(sum(len(r["starts"]) // (4 if r["slice"] < 0 else 32) for r in found))

    assert peak_mb(work) < 60
    assert sum(sent) == n * (2000 - 12)


def test_op3_hot_shingles_make_no_objects(spark):
    """The driver gets the widely shared shingles as numbers; as rows they took 93 MB."""
    n = op3_jaccard.HOT_LIST
    said = spark.range(2 * n).select(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(8).cast("long").alias("n"), (-F.col("id")).alias("key"))
    got = []
    assert peak_mb(lambda: got.append(op3_jaccard.hot_shingles(said))) < 20
    assert (got[0].view(np.int64) == np.arange(-2 * n + 1, -n + 1)).all()


def test_op3_a_large_group_of_candidates_travels_a_few_times(spark, monkeypatch):
    """Sets that are candidates of very many others are sent once a block of their group, not once a pair."""
    import random

    rng = random.Random(6)
    kept = {}
    real = op3_jaccard.written
    monkeypatch.setattr(op3_jaccard, "written", lambda frame, name: kept.setdefault(name, real(frame, name)))
    monkeypatch.setattr(op3_jaccard, "SMALL", 16)
    monkeypatch.setattr(op3_jaccard, "tasks", lambda session: 48)
    # Each text shares two passages with others: one group, few links.
    passages = [[f"p{i}x{k}" for k in range(30)] for i in range(24)]
    rows = []
    for i in range(240):
        a, b = rng.sample(range(24), 2)
        rows.append((i, " ".join(passages[a] + passages[b] + [f"own{i}x{k}" for k in range(2)])))
    got = {r.doc_id: r.component_id for r in op3_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split() for _, x in rows)]
    expected = list(range(240))
    for i in range(240):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and expected[i] != expected[j]:
                low, high = sorted((expected[i], expected[j]))
                expected = [low if x == high else x for x in expected]
    assert got == dict(enumerate(expected))
    owned = kept["owned"]
    sent = owned.select("cell", "a").union(owned.select("cell", "b")).distinct().count()
    classes = owned.select("a").union(owned.select("b")).distinct().count()
    assert owned.count() > 6 * classes > 1000 and sent <= 4 * classes
