"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from waymark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, node long, key string, kept string"


def brute(rows, least=0.95):
    ok = {k: np.array(v, np.float64) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    return [(i, links[k], min((x for x in ids[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def rows_of(seed, n=500, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(40)] + rng.standard_normal(width) * rng.choice([0.05, 0.2, 0.25, 2.0])
        out.append((i, v.astype(np.float32).tolist()))
    out += [(n + k, out[7][1]) for k in range(60)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = rows_of(seed)
    rows += [(None, rows[0][1]), (9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] + [1.0] * 23), (9005, [float("inf")] + [1.0] * 23), (9006, []), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (3, rows[9][1])]
    df = spark.createDataFrame([(i, v, 1, "k", "x") for i, v in rows], SCHEMA)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()]
    key = lambda x: tuple(map(str, x))
    want = brute(rows)
    same = sum(a == b for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    assert len(got) == len(want)
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in want)
    assert same >= 0.97 * len(want)
    for i, n, c in got:
        assert i is None or i < 9000 or (n, c) == ((1, 9007) if i in (9007, 9008) else (0, i))


def test_small_windows_still_find_links(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sum(r["n_links"] for r in vectors.near_vectors(df, window=8).collect())
    assert got >= 0.95 * sum(n for _, n, _ in brute(rows))


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = vectors.near_vectors(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).first()
    assert (one["n_links"], one["component_id"], one["kept"]) == (0, 4, True)
