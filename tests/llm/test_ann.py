"""Collision-counting search: recall against brute force, exact scores and ties."""

import numpy as np
import pytest

from quarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted(((-(v * w).sum(), j) for j, w in good if j != i and len(w) == len(v)), key=lambda x: x)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def search(spark, rows, **kw):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), **kw).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[i + 1] for i in range(len(x))] for q, x in got.items()}


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 32))
    v = centres[rng.integers(0, 8, 4000)] * 0.7 + rng.standard_normal((4000, 32)) * rng.uniform(0.5, 2, (4000, 1))
    return [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [1 << 19, 1 << 15])
def test_recall(spark, clusters, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_VALUES", block)
    monkeypatch.setattr(ann, "QUERY_VALUES", 1 << 11)
    want, got = brute(clusters), search(spark, clusters)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hits >= 0.93
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q in got for i, s in got[q] if (q, i) in scores)
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_ties_and_awkward_vectors(spark):
    rows = [(i, [1.0, 0.5, 0.0], 0) for i in range(60)] + [(100 + i, [1.0, float(i), 0.0], 0) for i in range(30)]
    rows += [(200, None, 0), (220, [], 0), (240, [0.0, 0.0, 0.0], 0), (260, [1.0, None, 0.0], 0), (280, [float("nan"), 1.0, 0.0], 0), (300, [float("inf"), 1.0, 0.0], 0), (None, [9.0, 9.0, 9.0], 0), (320, [1.0, 2.0], 0), (340, [1.0, -2.0], None)]
    got, want = search(spark, rows), brute(rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert [i for i, _ in got[0]][0] == 129 and [i for i, _ in got[320]] == [340]


def test_few_and_none(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0], 0)]) == {}
    assert search(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [2.0], 0)]) == {0: [(2, 2.0), (1, -1.0)]}
    more = spark.createDataFrame([(0, [1.0], 0), (1, [3.0], 0)], SCHEMA).selectExpr("*", "1 as dim", "2 as block", "3 as rank")
    assert ann.nearest(more).count() == 1
