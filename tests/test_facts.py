"""Facts over time against a replay fact by fact."""

import random

import pytest

from evidentia.operators import facts as FA

SHAPE = "memory_id string, seq long, project_id string, repository_id string, branch string, subject_key string, statement string, changes boolean, until long"


def replay(rows, window):
    """Supersessions, contradictions and ends, with every current fact of a subject kept; candidates are the newest ones that newer facts leave."""
    replaced, pairs, ended, kept = {}, set(), {}, {}
    for memory_id, seq, project, repository, branch, subject, statement, changes, until in sorted(rows, key=lambda r: (r[1], r[0])):
        if until is not None:
            ended[memory_id] = until
        if not subject:
            continue
        facts = kept.setdefault((project, subject), [])
        facts[:] = [f for f in facts if f[5] is None or f[5] > seq]
        others = [f for f in facts[-window:][::-1] if f[3] != statement]
        if changes:
            if others:
                replaced[others[0][0]] = (memory_id, seq)
                ended[others[0][0]] = min(seq, ended.get(others[0][0], seq))
                facts.remove(others[0])
        else:
            pairs |= {(min(memory_id, f[0]), max(memory_id, f[0]), seq) for f in others if f[1:3] == (repository, branch)}
        if until is None or until > seq:
            facts.append((memory_id, repository, branch, statement, changes, until))
    return replaced, pairs, ended


def made(seed, n, ends):
    r = random.Random(seed)
    # One subject holds a third of all facts.
    return [
        (f"f{i:04d}", i, f"p{r.randrange(2)}", r.choice([None, "r"]), r.choice([None, "a", "b"]), "hot" if r.random() < 0.4 else r.choice(["", None, "s1", "s2", "s3"]), r.choice([None, "", "x", "y", "z" * 5000]), r.choice([True, False, None]), i + r.randrange(1, 40) if ends and r.random() < 0.2 else None)
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "window", "ends"), [(1, 50, False), (2, 5, False), (3, 1000, True)])
def test_against_replay(spark, seed, window, ends):
    rows = made(seed, 400, ends)
    facts = spark.createDataFrame(rows, SHAPE)
    met = FA.arrivals(facts, window)
    replaced, pairs, ended = replay(rows, window)
    got = FA.superseded(met).collect()
    assert {r.memory_id: (r.superseded_by, r.superseded_at) for r in got} == replaced and len(got) == len(replaced) > 20
    valid = FA.validity(facts, met)
    assert {r.memory_id: r.ended for r in valid.where("ended is not null").collect()} == ended and valid.count() == len(rows)
    found = [(r.memory_id_a, r.memory_id_b, r.seq) for r in FA.open_contradictions(facts, met).collect()]
    assert sorted(found) == sorted(p for p in pairs if p[0] not in ended and p[1] not in ended) and found


def test_current_at_against_counting(spark):
    rows = made(4, 300, True)
    facts = spark.createDataFrame(rows, SHAPE)
    valid = FA.validity(facts, FA.arrivals(facts))
    asked = spark.createDataFrame([(i, p, s, q, "extra") for i, (p, s, q) in enumerate((p, s, q) for p in ("p0", "p9") for s in ("hot", "s1", "", None) for q in (-1, 0, 57, 150, 299, 9999))], "id long, project_id string, subject_key string, seq long, n string")
    told = [(r.project_id, r.subject_key, r.seq, r.ended) for r in valid.collect()]
    got = FA.current_at(valid, asked).collect()
    assert len(got) == 48
    for r in got:
        assert r.n_current == (sum(p == r.project_id and s == r.subject_key and a <= r.seq and (e is None or e > r.seq) for p, s, a, e in told) if r.subject_key else 0)
    assert any(r.n_current > 10 for r in got)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SHAPE)
    assert FA.arrivals(none).collect() == [] and FA.open_contradictions(none, FA.arrivals(none)).collect() == []
    one = spark.createDataFrame([("a", 1, "p", None, None, "s", "x", True, None)], SHAPE)
    assert [(r.supersedes_id, r.contradicts) for r in FA.arrivals(one).collect()] == [(None, [])]
