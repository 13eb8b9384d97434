"""Resampling weights against plain Python, radix ranks against a sort, checksums against zlib."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import awkward, empty, words
from waymark.llm import resampling
from waymark.llm.crc import run_crcs
from waymark.llm.words import words as hashed


def features(text):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in s}
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((k for k, (_, x) in enumerate(rows) if len(words(x)) >= 20), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, out[k][1]))
    for place, k in enumerate(fit[:percent * len(fit) // 100], 1):
        out[k].append(place)
    return sorted((tuple(x) if len(x) == 5 else (*x, None) for x in out), key=str)


def test_checksums_of_runs():
    texts = ["Plain words, and MORE", "", "ß é 漢字 🙂 x" * 40, "w" * 1000 + " " + "漢" * 700 + " end", None, "a", "b"]
    for w in hashed(pa.array(texts)):
        runs = run_crcs(w, 3)
        for row in range(w.lo, w.hi):
            own = words(texts[row])
            for n in (1, 2, 3):
                for i in range(len(own) - n + 1):
                    assert runs[n - 1][w.at[row - w.lo] + i] == zlib.crc32(" ".join(own[i:i + n]).encode())


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_weights_and_draw(spark, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(4)
    some = ["the", "The", "of", "é", "naïve", "漢字", "x1", "Spark", "row"]
    rows = [(i, " ".join(rng.choices(some, k=rng.randrange(60))) + rng.choice(["", "!", "\n"])) for i in range(300)]
    rows += [(None, rows[5][1]), (7, rows[5][1]), (8, None), (9, ""), (-4, rows[9][1]), (7, rows[5][1])]
    target = ["the of the Spark row", None, "x1 naïve " * 9]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [t for t in target if t], 40)


def test_awkward_and_empty(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "text string")
    out = resampling.resample(docs, none)
    assert out.count() == docs.count() and set(docs.columns) - {"text", "score"} <= set(out.columns)
    assert {(r["n_features"], r["weight"]) for r in out.where("n_features = 0").collect()} == {(0, 0)}
    assert resampling.resample(empty(spark), none).count() == 0


@pytest.mark.parametrize("digit, block", [(10, None), (3, 5), (1, 1000)])
def test_radix_rank(spark, digit, block):
    rng = random.Random(digit)
    rows = [(rng.choice([None, rng.randrange(-9, 9), rng.randrange(-10**6, 10**6)]), rng.choice([None, 3, rng.randrange(100)]), k) for k in range(400)]
    got = resampling.radix_rank(spark.createDataFrame(rows, "a long, b long, k long"), [("a", True), ("b", False)], "place", digit, block)
    got = sorted(map(tuple, got.collect()), key=lambda r: r[3])
    assert [r[3] for r in got] == list(range(1, 401)) and len({r[2] for r in got}) == 400
    key = lambda r: (r[0] is not None, -(r[0] or 0), r[1] is not None, r[1] or 0)
    assert [key(r) for r in got] == sorted(map(key, rows))


def test_radix_rank_of_extremes(spark):
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, None]
    df = spark.createDataFrame([(x,) for x in ends], "a long")
    got = [r["a"] for r in resampling.radix_rank(df, [("a", False)]).orderBy("rank").collect()]
    assert got == [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1]
    got = [r["a"] for r in resampling.radix_rank(df, [("a", True)]).orderBy("rank").collect()]
    assert got == [None, (1 << 63) - 1, 1, 0, -1, -(1 << 63)]
    same = spark.range(50).selectExpr("cast(null as long) as a")
    assert sorted(r["rank"] for r in resampling.radix_rank(same, [("a", False)]).collect()) == list(range(1, 51))


def test_gains_are_floors():
    assert np.floor(1000 * np.log(np.array([1.0])))[0] == 0
