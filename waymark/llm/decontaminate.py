"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are the queries, taken in blocks of bounded size; every passage of every text is searched. Features
are the words of a block's items, weighted by their inverse document frequency over the whole corpus. A
distributed randomised SVD (one pass of A'(A G) over all passages, items weighted to balance the corpus) gives the latent
space; passages close to an item by cosine are compared word by word: a near-verbatim common subsequence, or a
looser one that also keeps the item's answer, is a leak.

Words of very many documents carry no weight there, also when it is a leaking item that made them frequent. So
every run of RUN words of an item is looked up as well, whatever its words weigh, and the stretch around it is
compared in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.session import fresh
from waymark.llm.words import _BASE, Words, mix, words
from waymark.session import cut_lineage

#: Items searched for in one pass over the texts.
BLOCK = 256
RANK = 192
#: Words of a segment; a passage is SPAN segments and begins at every segment.
SEGMENT, SPAN = 24, 3
COSINE = 0.3
#: Share of an item's words that a text must hold in order, alone or with its answer.
VERBATIM, LOOSE = 0.8, 0.65
#: Words in more than this share of documents (and in more than FEW) carry no weight.
COMMON, FEW = 0.1, 20
#: Words in a row that are looked up: a text that holds VERBATIM of an item, others replaced, has so many (two of five words).
RUN = 3


class Vocabulary:
    """Numbers of known words; a small table of their low bits keeps most others from being looked up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.low = np.zeros(1 << 18, bool)
        self.low[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a known word, and its number."""
        at = np.flatnonzero(self.low[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        ok = self.hashes[k] == h[at]
        return at[ok], k[ok]


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = np.full(max(len(h) - size + 1, 0), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_BASE) + h[k:k + len(out)]
    return mix(out)


class Runs:
    """Places of every run of words of the items, by size: shorter runs only for items of few words."""

    def __init__(self, items):
        self.sizes = []
        for size in range(1, RUN + 1):
            of = [(i, _grams(np.array(codes, np.uint64), size)) for i, (_, codes, _) in enumerate(items) if size == (RUN if len(codes) > 5 else min(2, len(codes)))]
            if of:
                grams = np.concatenate([g for _, g in of])
                known = Vocabulary(grams)
                k = np.searchsorted(known.hashes, grams)
                order = np.argsort(k, kind="stable")
                item = np.concatenate([np.full(len(g), i) for i, g in of])[order]
                place = np.concatenate([np.arange(len(g)) for _, g in of])[order]
                self.sizes.append((size, known, np.searchsorted(k[order], np.arange(len(known.hashes) + 1)), item, place))

    def find(self, w: Words) -> np.ndarray:
        """Distinct (row, item, word at which the item would begin) of all runs that rows of ``w`` hold, in order."""
        found = [np.zeros((0, 3), np.int64)]
        for size, known, first, item, place in self.sizes:
            at, k = known.find(_grams(w.hashes, size))
            rows = np.searchsorted(w.at, at, "right") - 1
            inside = at + size <= w.at[rows + 1]
            at, k, rows = at[inside], k[inside], rows[inside]
            n = first[k + 1] - first[k]
            which = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(rows, n), item[which], np.repeat(at, n) - place[which]], axis=1))
        return np.unique(np.concatenate(found), axis=0)


def lcs(pattern: Sequence[int], text: Sequence[int]) -> int:
    """Length of the longest common subsequence, a machine-word-parallel row at a time."""
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for y in text:
        if m := masks.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _items(rows) -> list[tuple[int, list[int], list[int]]]:
    """(id, words, words of the answer): what follows the last question mark or colon, else the last quarter."""
    out = []
    for r in rows:
        text = r["text"] or ""
        codes = [int(h) for w in words(pa.array([text])) for h in w.hashes]
        cut = max(text.rfind("?"), text.rfind(":")) + 1
        tail = [int(h) for w in words(pa.array([text[cut:]])) for h in w.hashes] if cut else []
        if codes:
            out.append((r["id"], codes, tail if 0 < len(tail) < len(codes) else codes[-max(1, len(codes) // 4):]))
    return out


def _segments(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First segment of each row, and the segment of each word."""
    size = np.diff(w.at)
    at = np.concatenate([[0], np.cumsum(-(-size // SEGMENT))])
    rows = w.rows()
    return at, at[rows] + (np.arange(len(rows)) - w.at[rows]) // SEGMENT


def _sums(seg: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by segment; ``seg`` ascends."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(seg):
        begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        out[seg[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


def _frequencies(texts: DataFrame, vocab) -> np.ndarray:
    """Documents that hold each known word, and all documents last."""
    n = len(vocab.value.hashes)

    def count(batches):
        total = np.zeros(n + 1, np.int64)
        for b in batches:
            total[n] += b.num_rows
            for w in words(b.column(0)):
                at, k = vocab.value.find(w.hashes)
                rows = np.searchsorted(w.at, at, "right") - 1
                total[:n] += np.bincount(np.unique(rows * np.int64(n) + k) % n, minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(n + 1, np.int64)
    for r in texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["k"]] = r["n"]
    return out


def _sketch(texts: DataFrame, vocab, weight, probe) -> np.ndarray:
    """Sum of a' (a G) over all corpus passages a (disjoint here, unit length), and their number last."""
    n, width = len(vocab.value.hashes), probe.value.shape[1]
    slab = 512

    def run(batches):
        total, seen = np.zeros((n, width)), 0
        for b in batches:
            for w in words(b.column(0)):
                at, k = vocab.value.find(w.hashes)
                if not len(at):
                    continue
                rows = np.searchsorted(w.at, at, "right") - 1
                long = -(-np.diff(w.at) // (SEGMENT * SPAN))
                first = np.concatenate([[0], np.cumsum(long)])
                p = first[rows] + (at - w.at[rows]) // (SEGMENT * SPAN)
                p = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
                x = weight.value[k]
                square = np.bincount(p, x * x)
                x = (x / np.sqrt(square)[p]).astype(np.float32)
                y = _sums(p, probe.value[k] * x[:, None], len(square))
                seen += len(square)
                order = np.argsort(k, kind="stable")
                ks = k[order]
                begin = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
                total[ks[begin]] += np.add.reduceat(y[p[order]] * x[order, None], begin, axis=0)
        for lo in range(0, n, slab):
            yield pa.RecordBatch.from_arrays([pa.array([lo // slab]), pa.array([total[lo:lo + slab].tobytes()], pa.binary()), pa.array([seen if lo == 0 else 0])], names=["slab", "part", "seen"])

    def add(pdf):
        return pdf.head(1).assign(part=[np.sum([np.frombuffer(x) for x in pdf["part"]], axis=0).tobytes()], seen=[pdf["seen"].sum()])

    # Parts are summed in groups of forty tasks, these in groups of forty, and so on: no task holds those of the whole corpus.
    parts = texts.mapInArrow(run, "slab long, part binary, seen long").withColumn("g", F.spark_partition_id().cast("long"))
    for fan in (40, 40, 1 << 40):
        parts = parts.withColumn("g", F.floor(F.col("g") / fan)).groupBy("slab", "g").applyInPandas(add, "slab long, part binary, seen long, g long")
    out, seen = np.zeros((n, width)), 0
    for r in parts.toLocalIterator():
        out[r["slab"] * slab:(r["slab"] + 1) * slab] = np.frombuffer(bytes(r["part"])).reshape(-1, width)
        seen += r["seen"]
    return out, seen


def _latent(items, vocab, weight: np.ndarray, sketch: np.ndarray, seen: int, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x rank basis times word weight, unit item vectors): items count as much in all as the corpus."""
    a = np.zeros((len(items), len(vocab.hashes)))
    for i, (_, codes, _) in enumerate(items):
        _, k = vocab.find(np.array(codes, np.uint64))
        np.add.at(a[i], k, weight[k])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    b = a.T @ (a @ probe) + sketch * (len(items) / max(seen, 1))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    u = u[:, s > 1e-9 * max(s[0], 1e-300)][:, :RANK]
    q = a @ u
    return (u * weight[:, None]).astype(np.float32), (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _needs(items, vocab: Vocabulary) -> list[tuple[set[int], int, set[int], int]]:
    """For each item its weighted words, how many of them any leak must hold, all its words and the number of repeats.

    Words without weight and repeats are taken as held, so these bounds never lose a common subsequence.
    """
    out = []
    for _, codes, _ in items:
        _, k = vocab.find(np.array(codes, np.uint64))
        own = set(k.tolist())
        out.append((own, int(np.ceil(LOOSE * len(codes) - 1e-9)) - (len(codes) - len(own)), set(codes), len(codes) - len(set(codes))))
    return out


def _same(items, item: int, have: list[int]) -> float | None:
    """Share of the item's words that ``have`` holds in order, if that is a leak."""
    _, codes, answer = items[item]
    share = lcs(codes, have) / len(codes)
    if share >= VERBATIM or share >= LOOSE and lcs(answer, have) >= LOOSE * len(answer):
        return share
    return None


def _search(vocab, latent, items, runs, names):
    def run(batches):
        basis, q = latent.value
        needs = _needs(items.value, vocab.value)
        widest = max(SEGMENT, *(len(codes) for _, codes, _ in items.value))
        for b in batches:
            took: list[int] = []
            out: list[tuple] = []
            for w in words(b.column(b.num_columns - 1)):
                at, k = vocab.value.find(w.hashes)
                first, seg = _segments(w)
                z = _sums(seg[at], basis[k], first[-1])
                total = z.copy()
                owner = np.repeat(np.arange(w.hi - w.lo), np.diff(first))
                for j in range(1, SPAN):
                    same = owner[j:] == owner[:-j]
                    total[:-j][same] += z[j:][same]
                size = np.linalg.norm(total, axis=1)
                live = np.flatnonzero(size > 0)
                close = (total[live] / size[live, None]) @ q.T
                best: dict[tuple[int, int], tuple] = {}
                near, which = np.nonzero(close >= COSINE)
                last, words_of = -1, set()
                for p, item in zip(near.tolist(), which.tolist(), strict=True):
                    if p != last:
                        last, s, row = p, int(live[p]), int(owner[live[p]])
                        begin = int(w.at[row]) + (s - int(first[row])) * SEGMENT
                        lo = max(int(w.at[row]), begin - widest)
                        hi = min(int(w.at[row + 1]), begin + SEGMENT * SPAN + widest)
                        words_of = set(k[np.searchsorted(at, lo):np.searchsorted(at, hi)].tolist())
                        all_of = None
                    own, need, every, repeats = needs[item]
                    if len(own & words_of) < need:
                        continue
                    if all_of is None:
                        all_of = set(w.hashes[lo:hi].tolist())
                    if len(every & all_of) < LOOSE * (len(every) + repeats) - repeats:
                        continue
                    share = _same(items.value, item, w.hashes[lo:hi].tolist())
                    if share is not None:
                        got = (round(share, 6), round(float(close[p, item]), 4), begin - int(w.at[row]))
                        if got > best.get((row, item), (-1,)):
                            best[row, item] = got
                for row, item, d in runs.value.find(w).tolist():
                    if best.get((row, item), (0,))[0] == 1:
                        continue
                    size_of = len(items.value[item][1])
                    lo = max(int(w.at[row]), d - size_of // 2)
                    hi = min(int(w.at[row + 1]), d + size_of + size_of // 2)
                    own, need, _, _ = needs[item]
                    if need > 0 and len(own.intersection(k[np.searchsorted(at, lo):np.searchsorted(at, hi)].tolist())) < need:
                        continue
                    share = _same(items.value, item, w.hashes[lo:hi].tolist())
                    if share is not None:
                        s = max(d - int(w.at[row]), 0) // SEGMENT
                        p = int(np.searchsorted(live, first[row] + s))
                        cosine = float(close[p, item]) if p < len(live) and live[p] == first[row] + s else 0.0
                        got = (round(share, 6), round(cosine, 4), s * SEGMENT)
                        if got > best.get((row, item), (-1,)):
                            best[row, item] = got
                for (row, item), got in sorted(best.items()):
                    took.append(w.lo + row)
                    out.append((items.value[item][0], *got))
            at = pa.array(took, pa.int64())
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in b.columns[:-1]), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (columns ``keep``, item_id, share, cosine, first_word) for each row of ``docs`` and item that leaks into it.

    ``share`` is the part of the item's words that the text holds in order, ``first_word`` where the passage
    begins; ``cosine`` is 0 for a passage without weighted words. Items without words (null or empty) never leak; texts without words hold none. Repeated items and rows
    each count. Columns of ``keep`` called like the new ones are left out.
    """
    new = [T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("first_word", T.LongType())]
    keep = [c for c in keep if c not in {f.name for f in new}]
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(fresh(list(keep), "_text")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], *new])
    out = None
    block: list = []
    queries = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).toLocalIterator()
    more = True
    while more:
        block = []
        for r in queries:
            block.append(r)
            if len(block) == BLOCK:
                break
        more = len(block) == BLOCK
        items = _items(block)
        if not items:
            continue
        vocab = Vocabulary(np.array([h for _, codes, _ in items for h in codes], np.uint64))
        voc = send(vocab)
        count = _frequencies(texts, voc)
        n, df = count[-1], count[:-1]
        rare = df <= max(COMMON * n, FEW)
        vocab, weight = Vocabulary(vocab.hashes[rare]), (np.log((n + 1) / (df + 1)) + 1)[rare]
        voc = send(vocab)
        if len(weight):
            probe = np.random.default_rng(7).standard_normal((len(vocab.hashes), min(RANK + 16, len(vocab.hashes))))
            sketch, seen = _sketch(texts, voc, send(weight), send(probe.astype(np.float32)))
            latent = send(_latent(items, vocab, weight, sketch, seen, probe))
        else:
            latent = send((np.zeros((0, 1), np.float32), np.zeros((len(items), 1), np.float32)))
        found = rows.mapInArrow(_search(voc, latent, send(items), send(Runs(items)), [f.name for f in schema]), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns. Rows are told apart by id and text, so equal ones go together."""
    i, h, bad_i, bad_h = fresh(docs.columns, "_i", "_h", "_bi", "_bh")
    rows = docs.select("*", F.col(doc_id).alias(i), F.xxhash64(F.col(text)).alias(h))
    bad = cut_lineage(find_leaks(rows, benchmark, text, keep=(i, h)).select(i, h).distinct().toDF(bad_i, bad_h))
    return rows.join(bad, F.col(i).eqNullSafe(F.col(bad_i)) & (F.col(h) == F.col(bad_h)), "left_anti").select(*docs.columns)
