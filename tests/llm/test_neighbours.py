"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node long, key string, rank string"


def brute(rows, k=5, asks=lambda i: i % 5 == 0):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in ok]
    out = []
    for a, (i, v) in enumerate(unit):
        if asks(i):
            near = sorted(((-float(v @ w), j) for b, (j, w) in enumerate(unit) if a != b and len(v) == len(w)), key=lambda x: (round(x[0], 12), x[1]))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return out


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, 1, "k", "x") for i, v in rows], SCHEMA.replace("float", kind))
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(r) for r in got.collect()]


def clustered(seed, n=900, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, width)) * 2
    rows = [(i, (centres[rng.integers(30)] + rng.standard_normal(width) * rng.choice([0.1, 1.0])).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + k, rows[7][1]) for k in range(60)]


@pytest.mark.parametrize("options", [{}, {"leaf": 16}, {"leaf": 16, "trees": 3, "most": 300}])
def test_recall(spark, monkeypatch, options):
    monkeypatch.setattr(neighbours, "MEMBERS", 40)
    rows = clustered(1)
    want, got = brute(rows), found(spark, rows, **options)
    assert len(got) == len(want)
    same = {(q, j) for q, _, j, _ in want} & {(q, j) for q, _, j, _ in got}
    assert len(same) >= 0.9 * len(want)
    score = {(q, j): s for q, _, j, s in brute(rows, len(rows))}
    assert all(abs(score[q, j] - s) < 1e-9 for q, _, j, s in got)
    for q in {x[0] for x in got}:
        own = sorted(x for x in got if x[0] == q)
        assert [x[1] for x in own] == [1, 2, 3, 4, 5] and all(a[3] >= b[3] for a, b in zip(own, own[1:], strict=False))


def test_fewer_leaves_on_clustered_vectors():
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    tight = unit(np.repeat(rng.standard_normal((64, 16)), 32, axis=0) + rng.standard_normal((2048, 16)) * 0.05)
    loose = unit(rng.standard_normal((2048, 16)))
    visits = []
    for m in (tight, loose):
        forest, share = neighbours.fit_forest(m, 6, leaf=32)
        sizes = [np.bincount(t.leaf_of(m), minlength=t.leaves) for t in forest]
        far = neighbours.reach(m[:50] @ m.T, 6)
        visits.append(sum(len(neighbours.search(forest, sizes, q, share * d, 6)) for q, d in zip(m[:50], far, strict=True)))
    assert visits[0] == 50 * neighbours.TREES and visits[1] > 3 * visits[0]  # the first leaf of each tree is enough


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (105, [0.0, 2.0]), (110, [-1.0, 0.0]), (115, [1.0, 2.0, 3.0])]
    rows += [(None, [1.0, 1.0]), (120, None), (125, [0.0, 0.0]), (130, [float("nan"), 1.0]), (135, [None, 1.0]), (140, [float("inf"), 1.0]), (145, []), (10, [1.0, 0.0]), (10, [0.0, 1.0])]
    got, want = found(spark, rows), brute(rows)
    tidy = lambda x: sorted((q, r, j, round(s, 9)) for q, r, j, s in x)
    assert tidy(got) == tidy(want)


def test_doubles_beyond_floats(spark):
    rows = [(0, [1e300, 2e300, 0.0]), (1, [1e-300, 2e-300, 0.0]), (2, [3.0, 1.0, 1.0]), (3, [-0.0, 1e308, 1e308])]
    got, want = found(spark, rows, "double"), brute(rows)
    assert [(q, r, j) for q, r, j, _ in sorted(got)] == [(q, r, j) for q, r, j, _ in sorted(want)]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_few_rows(spark):
    assert found(spark, []) == [] and found(spark, [(5, [1.0, 2.0])]) == []
    assert [(q, r, j) for q, r, j, _ in found(spark, [(5, [1.0, 2.0]), (6, [2.0, 1.0])])] == [(5, 1, 6)]
