"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.common import awkward, empty, lower
from waymark.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(n):
    side = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in side.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, n[w], form[w], form[w] and n[form[w]], root(w), len(side[w])) for w in n), key=str)


def vocabulary(rng, size, letters):
    out = {}
    while len(out) < size:
        w = "".join(rng.choices(letters, k=rng.randrange(5, 9)))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            if len(w) >= 5:
                out[w] = rng.choice([3, 3, 4, 7, 20, 300])
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeéß", "aaaab"])
def test_forms_against_all_pairs(spark, letters):
    n = vocabulary(random.Random(letters), 31 if letters == "ab" else 300, letters)
    got = spelling.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(n)


def test_words_of_documents(spark):
    rng = random.Random(2)
    some = ["House", "houses", "mouse", "naïveté", "Éclair", "éclair", "colour", "color", "tiny", "x", "Straße", "漢字", "waters", "÷times×"]
    rows = [(i, " ".join(rng.choices(some, k=30))) for i in range(200)] + [(None, "colour " * 5), (3, "colour colour"), (3, "colour colour"), (4, None), (5, ""), (6, "verylongword" * 5000 + " ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == counted(rows)
    assert sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=str) == brute(counted(rows))


def test_awkward_and_empty(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark, [(8, "spelling speling spelling")] * 4).collect()]
    got = spelling.spelling_variants(awkward(spark, [(8, "spelling speling spelling")] * 4))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(counted(rows))


@pytest.mark.parametrize("seed", range(20))
def test_pivots_cost_least(seed):
    rng = random.Random(seed)
    places = sorted(rng.sample(range(9), 5))
    costs = [rng.randrange(20) for _ in places]
    ways = [(costs[i] + costs[j]) for i in range(5) for j in range(i + 1, 5) if places[j] - places[i] >= 2]
    i, j = spelling.pivots(places, costs)
    assert places[j] - places[i] >= 2 and costs[i] + costs[j] == min(ways)
