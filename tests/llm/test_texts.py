"""Word hashes, toxicity, near-duplicates, leaks, pieces and shards against plain Python."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import awkward, empty, words
from waymark.llm import components, decontaminate, minhash, pieces, shards, toxicity
from waymark.llm import words as W
from waymark.session import read_table


def babble(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x{rng.randrange(9)}" for _ in range(n))


def test_words_equal_a_regular_expression():
    texts = ["", None, "a", "Ab-aB ab", "ß É 漢字🙂 1a", "x" * 9000 + " y", "one two " * 60_000, "\x00b\x7fc"]
    seen = {}
    for w in W.words(pa.array(texts), piece=1 << 12):
        for row in range(w.lo, w.hi):
            codes = w.hashes[w.at[row - w.lo]:w.at[row - w.lo + 1]].tolist()
            want = words(texts[row])
            assert len(codes) == len(want)
            assert all(seen.setdefault(x, c) == c for x, c in zip(want, codes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def toxic_rows(n=600):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        t = babble(rng, rng.randrange(20, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(["grumpf", "blarg", "zonk"])
        docs.append((i, " ".join(t)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, lab, keep=["doc_id"]).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    own = [i for i, _ in docs if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in own) >= 0.95 * len(own)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_in_parts_is_the_same(spark, monkeypatch):
    docs, labels = toxic_rows()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = {r["doc_id"]: round(r["score"], 6) for r in toxicity.score_toxicity(d, lab).collect()}
    monkeypatch.setattr(toxicity, "MOST_NGRAMS", 2)
    monkeypatch.setattr(toxicity, "MOST_LABELS", 0)
    assert {r["doc_id"]: round(r["score"], 6) for r in toxicity.score_toxicity(d, lab).collect()} == whole


def plain_ratio(train, d=0.75, chance=18.0):
    """Kneser-Ney by the book over (text, toxic): a function from words to the log ratio of each after its left neighbour."""
    pairs, docs, pair_docs = ([collections.Counter() for _ in range(2)] for _ in range(3))
    for text, t in train:
        w = words(text)
        p = list(zip(["<s>", *w], w))
        pairs[t].update(p)
        docs[t].update(set(w))
        pair_docs[t].update(set(p))
    left = [collections.Counter(w for _, w in pairs[t]) for t in (0, 1)]
    context = [collections.Counter() for _ in range(2)]
    for t in (0, 1):
        for (v, _), n in pairs[t].items():
            context[t][v] += n
    both = left[0] + left[1]

    def beyond(counts):
        share = counts[1].total() / (counts[0].total() + counts[1].total())
        g = {}
        for k in counts[0] | counts[1]:
            x, y = counts[1][k], counts[0][k]
            g[k] = 2 * sum(n * np.log(n / ((x + y) * s)) for n, s in ((x, share), (y, 1 - share)) if n)
        return {k for k, v in g.items() if v >= chance}

    kept, kept_pairs = beyond(docs), beyond(pair_docs)

    def word(w, t):
        own = max(left[t][w] - d, 0) / left[t].total() if w in kept else 0.0
        rest = 1 - sum(max(left[t][x] - d, 0) for x in kept) / left[t].total()
        return own, rest

    def log_p(v, w, t):
        own, rest = word(w, t)
        low = own + rest * (both[w] / both.total() if w in both else 1e-9)  # what no model has seen has the same share in both
        n = max(context[t][v], 1)
        used = sum(max(pairs[t][p] - d, 0) for p in kept_pairs if p[0] == v)
        return np.log((max(pairs[t][v, w] - d, 0) / n if (v, w) in kept_pairs else 0.0) + (1 - used / n) * low)

    return lambda ws: [log_p(v, w, 1) - log_p(v, w, 0) for v, w in zip(["<s>", *ws], ws)], kept, kept_pairs


def test_toxicity_model_is_plain_kneser_ney(spark):
    """Left neighbours as continuations, pairs of both classes (also those that only ordinary texts have), back-off weights."""
    rng = random.Random(11)
    train = []
    for i in range(400):
        t = babble(rng, rng.randrange(5, 40), 12).split()
        # The same two words stand together in ordinary texts, apart in toxic ones; one word repeats after one neighbour only.
        t += (["nice", "day"] if i % 2 else ["day", *t[:2], "nice"]) + (["grumpf", "zonk"] * 4 if i % 2 == 0 and i % 3 else [])
        train.append((" ".join(t), int(i % 2 == 0)))
    plain, kept, kept_pairs = plain_ratio(train)
    assert ("nice", "day") in kept_pairs and "grumpf" in kept and len(kept) < 20
    rows = spark.createDataFrame(train, "text string, toxic int")
    asked = ["nice day", "day nice", "grumpf zonk grumpf unheard", "", "day of grumpf", *(t for t, _ in train[:6])]
    parts = toxicity._parts(toxicity.model(rows))
    docs = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    seen, x1, _ = toxicity._features(docs, parts, "text", ["id"])
    for i, x in seen.select("id", x1.alias("x")).collect():
        want = plain(words(asked[i]))
        assert x == pytest.approx(sum(want) / max(len(want), 1), abs=1e-5)
    assert sum(plain(["nice", "day"])) < sum(plain(["day", "nice"]))


def test_toxicity_ignores_labels_of_held_out_documents(spark):
    docs, labels = toxic_rows(200)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_awkward_toxicity(spark):
    docs, labels = toxic_rows(200)
    d = awkward(spark, [(i + 100, t) for i, t in docs])
    lab = spark.createDataFrame([(i + 100, t, 1) for i, t in labels] + [(None, 1, 1), (101, None, 1), (102, 7, 1), (103, 0, 1), (103, 0, 1)], "doc_id long, toxic int, text int")
    got = toxicity.score_toxicity(d, lab)
    assert got.count() == d.count() and set(got.columns) == {*d.columns, "held_out", "score", "predicted"}
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.collect())
    for x, y in ((d, lab.limit(0)), (empty(spark), lab), (d, lab.where("toxic = 0"))):
        rows = toxicity.score_toxicity(x, y).collect()
        assert len(rows) == x.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)


# --- near-duplicates -------------------------------------------------------------------------------------------------


def brute_classes(rows, size=5, least=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    own = {t: root(k) for k, t in enumerate(texts)}
    least_id = collections.defaultdict(list)
    for i, t in rows:
        least_id[own[t or ""]].append(i)
    head = {k: min([x for x in v if x is not None], default=None) for k, v in least_id.items()}
    return [(i, head[own[t or ""]]) for i, t in rows], len(set(own.values()))


def near_rows(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = babble(rng, rng.choice([8, 40, 120, 300]), 5000).split()
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 12)):
                t[rng.randrange(len(t))] = babble(rng, 1, 9999)
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + k, rows[3][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    docs = awkward(spark, [(i + 100, t) for i, t in rows])
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = minhash.classes(docs).collect()
    want, n = brute_classes(plain)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=key) == sorted(want, key=key)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == n == sum(r["kept"] for r in got)


def test_chain_through_a_middle_text(spark):
    """Ends of a chain are less similar than 0.8 but one class, whatever text a bucket is compared with."""
    base = [f"a{i}" for i in range(100)]
    rows = [(k, " ".join([*base[:100 - 3 * k], *(f"b{i}" for i in range(3 * k))])) for k in range(8)]
    got = {r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for _, c in brute_classes(rows)[0]} == got


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    sig = minhash.dart_signatures(np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([wa, wb]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    half = minhash.dart_signatures(np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([wa, wa / 2]), 2, 2000)
    assert abs((half[0] == half[1]).mean() - 0.5) < 0.05


def test_near_duplicates_of_nothing(spark):
    assert minhash.classes(empty(spark)).count() == 0 and minhash.keep_first(empty(spark)).count() == 0


# --- leaks -----------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(9)
    items = [babble(rng, rng.randrange(12, 60), 4000) for _ in range(30)]
    docs, want = [], set()
    for k in range(300):
        t = babble(rng, rng.randrange(50, 400), 4000).split()
        if k % 3 == 0:
            at, item = rng.randrange(len(t)), k % len(items)
            part = items[item].upper().split()
            if k % 2:
                for _ in range(len(part) // 10):
                    part[rng.randrange(len(part))] = "other"
            t[at:at] = part
            want.add((k, item))
        docs.append((k, " ".join(t)))
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    d = awkward(spark, [(i + 100, t) for i, t in docs])
    got = {(r["doc_id"] - 100, r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()}
    assert got == want
    clean = decontaminate.without_leaks(d, bench)
    assert clean.columns == d.columns and clean.count() == d.count() - len({i for i, _ in want})


def test_leaks_of_more_items_than_a_block(spark, monkeypatch):
    rng = random.Random(4)
    items = [babble(rng, 20, 4000) for _ in range(9)]
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    d = spark.createDataFrame([(i, f"{babble(rng, 60, 4000)} {t}") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()} == {(i, i) for i in range(9)}


@pytest.mark.parametrize("others", [0, 20])
def test_leaks_into_a_third_of_the_documents(spark, others):
    rng = random.Random(5)
    items = [*(babble(rng, n, 4000) for n in (30, 5)), *(babble(rng, 20, 4000) for _ in range(others))]
    docs, want = [], set()
    for k in range(300):
        t = babble(rng, 200, 4000).split()
        for item in range(2):
            if k % 3 == item:
                part = items[item].split()
                for i in range(2, len(part), 5):
                    part[i] = f"other{k}" if k % 2 else part[i]
                at = rng.randrange(len(t))
                t[at:at] = part
                want.add((k, item))
        docs.append((k, " ".join(t)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaks_spread_among_words_of_other_items(spark):
    rng = random.Random(6)
    names = [f"w{i}x" for i in range(412)]
    rng.shuffle(names)
    items = [" ".join(names[:12]), *(" ".join(names[12 + k * 20:32 + k * 20]) for k in range(20))]
    docs = []
    for k in range(7):
        other = rng.sample(names[12:], 60)
        docs.append((k, " ".join(" ".join([*names[i * 2:i * 2 + 2], *other[i * 10:i * 10 + 10]]) for i in range(6))))
    d = spark.createDataFrame([*docs, *((k, " ".join(rng.sample(names[12:], 72))) for k in range(7, 40))], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["cosine"] for r in decontaminate.find_leaks(d, bench).collect()}
    assert set(got) == {(k, 0) for k in range(7)}, got
    assert min(got.values()) < 0.45, got


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(awkward(spark), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(awkward(spark), bench.limit(0)).count() == awkward(spark).count()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


# --- pieces ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces()


PIECE_TEXTS = [
    (60, "Hello,  world!\n\ttabs "), (61, " leading and trailing  "), (62, "日本語のテキスト ñandú Straße 🙂👍🏽"), (63, "=" * 300 + "-" * 77), (64, "a" * 500), (65, "▁under▁line"),
    (66, "https://example.com/a_b?c=1&d=2"), (67, "1234567890 3.14159"), (68, "\x00\x01\x7f"), (69, "internationalization " * 50),
]


def test_pieces_equal_the_library(spark, folder, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = awkward(spark, PIECE_TEXTS).select("doc_id", "text", "ids").unionByName(read_table(spark, folder, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("ids")))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((str(i), library.encode(t or "")) for i, t in texts)
    coded = pieces.encode(docs, model)
    assert sorted((str(r["id"]), list(r["ids"])) for r in coded.collect()) == want
    report = pieces.piece_report(docs, model).collect()
    assert all(r["round_trip"] for r in report)
    sums = sorted((str(i), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest()) for i, x in ((i, library.encode(t or "")) for i, t in texts))
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in report) == sums


def test_decoding(spark, model):
    coded = pieces.encode(awkward(spark, PIECE_TEXTS), model)
    back = pieces.decode(coded.withColumn("text", F.lit("old")), model)
    want = sorted((str(r["doc_id"]), (r["text"] or "").replace("▁", " ")) for r in awkward(spark, PIECE_TEXTS).collect())
    assert sorted((str(r["id"]), r["text"]) for r in back.collect()) == want
    nothing = pieces.encode(empty(spark), model)
    assert nothing.count() == 0


def test_viterbi_takes_the_best_path(spark):
    table = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "ba": -3.5, "▁a": -4.5, "aba": -7.5, "bab": -5.0}
    rows = sorted(((p, i, s) for i, (p, s) in enumerate(table.items())), key=lambda x: (-x[2], x[1]))
    model = pieces.Pieces(tuple(rows), (), 99, "unigram", ())
    texts = ["▁", "▁ab", "▁abab", "▁babab", "▁aabb", "▁acb"]
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(t, 1) for t in texts], "word string, block long"), model).collect()}
    ids = {p: i for p, i, _ in rows}
    floor = min(table.values()) - 10

    def best(text):
        paths = [(0.0, [])] + [(-1e9, None)] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                score, token = (table[text[s:e]], ids[text[s:e]]) if text[s:e] in table else (floor, 99) if s == e - 1 else (-1e9, None)
                if token is not None and paths[s][0] + score > paths[e][0]:
                    paths[e] = (paths[s][0] + score, [*paths[s][1], token])
        return paths[-1]

    scores = {i: s for _, i, s in rows} | {99: floor}
    for t in texts:
        assert sum(scores[i] for i in got[t]) == pytest.approx(best(t)[0]), t


def test_merges_by_fold_equal_those_by_queue(spark, model):
    draw = np.random.default_rng(3)
    parts = [p for p, _, _ in model.pieces if "▁" not in p and len(p) < 6]
    words = sorted({"▁" * int(k % 2) + "".join(draw.choice(parts, 1 + k % 8))[:40] for k in range(300)} | {"a", "▁", "aaaaaaa", "żż", "▁▁▁▁▁"})
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w, 1) for w in words], "word string, block long"), model).collect()}
    rank, id_of = {p: r for r, (p, _, _) in enumerate(model.pieces)}, {p: i for p, i, _ in model.pieces}
    for w in words:
        want = [[id_of[p]] if p in id_of else [model.bytes_[x] for x in p.encode()] for p in pieces.merge_long(w, rank)]
        assert got[w] == [x for p in want for x in p], w


def test_islands_are_numbered_by_frequency(model):
    texts = ["", " a b a", " the cat żółć the  end\n" * 40, " " + "x" * 60 + " a", " a"]
    found = pieces.islands(pa.array(texts), pieces.Reach(model))
    of = dict(zip(found.short_at.tolist(), found.short.to_pylist(), strict=True)) | found.long
    assert "".join(of[x] for x in found.index.tolist()) == "".join(texts) and found.counts.sum() == len(found.index) and found.counts[0] == 0
    often = np.bincount(found.index)
    assert (np.diff(often) <= 0).all() and all(len(t) <= pieces.LONG for t in found.short.to_pylist()) and all(len(t) > pieces.LONG for t in found.long.values())
    assert pieces.islands(pa.array([*texts[:-1], " c"]), pieces.Reach(model)).tag != found.tag


def test_decoding_takes_no_loop_over_ids(model):
    import sys

    steps = 0

    def count(frame, event, _):
        nonlocal steps
        steps += event == "line"
        frame.f_trace_opcodes = False
        return count

    ids = pa.array([[5, 300, 301] * 5000, [], [259, 5]], pa.list_(pa.int32()))
    pieces.decode_batch(ids.slice(1), model)
    sys.settrace(count)
    try:
        got = pieces.decode_batch(ids, model)
    finally:
        sys.settrace(None)
    want = [b"".join(model.text_of[i] for i in x) for x in ids.to_pylist()]
    assert got == [w[1:] if w.startswith(b" ") else w for w in want] and steps < 1000


# --- shards ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    at = np.arange(n)
    slot = shards.permute(at, n, 7)
    assert sorted(slot.tolist()) == at.tolist() and (shards.permute(slot, n, 7, inverse=True) == at).all()
    assert n < 100 or (slot != shards.permute(at, n, 8)).any()


def test_shards(spark, tmp_path):
    rng = random.Random(6)
    docs = awkward(spark, [(100 + i, babble(rng, rng.randrange(1, 80))) for i in range(120)]).repartition(3)
    folder, index = shards.write_shards(docs, f"file://{tmp_path}/s", length=16, per_shard=50)
    rows = index.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    stored = {r["slot"]: r["ids"] for r in shards.read_shards(spark, folder, 16, 50).collect()}
    assert all(zlib.crc32(bytes(stored[r["slot"]])) == r["check"] for r in rows)
    with open(shards.TOKENIZER, "rb") as f:
        encode, end = shards._encoder(f.read())
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    assert sum(r["n_tokens"] for r in rows) == sum(len(encode.encode_ordinary(t)) + 1 for t in texts)
    want = collections.Counter(x for t in texts for x in [*encode.encode_ordinary(t), end])
    got = collections.Counter(int(x) for b in stored.values() for x in np.frombuffer(bytes(b), "<u2"))
    assert got - want == collections.Counter({end: sum(16 - r["n_tokens"] for r in rows)}) and not want - got
    tail = list(shards.slots_from(f"{tmp_path}/s", 73, 16, 50))
    assert len(tail) == len(rows) - 73 and all(x.tobytes() == bytes(stored[73 + k]) for k, x in enumerate(tail))


def test_shard_report(spark):
    got = shards.shard_report(awkward(spark), length=16, per_shard=50).collect()
    assert got and all(r["stored"] for r in got)
    assert None in {i for r in got for i in r["doc_ids"]}
    assert shards.shard_report(empty(spark)).count() == 0
