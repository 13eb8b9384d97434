"""Near-duplicate texts by DartMinHash signatures and banding.

Every shingle of a text owns a region as wide as its weight. Hashed darts are thrown into it along a rank axis (a
Poisson process that depends on the shingle alone), each aimed at one of the signature's coordinates; the
earliest dart of each coordinate stays. Two texts agree in a coordinate with their weighted Jaccard
similarity. A text needs about k ln k darts in all, however many shingles it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.components import components
from waymark.llm.session import fresh
from waymark.llm.words import PIECE, mix, shingles, words
from waymark.session import cut_lineage

SIZE = 5
LEAST = 0.8
#: 20 bands of 5 coordinates find a pair of similarity 0.8 with probability 0.9996.
BANDS, DEPTH = 20, 5
#: Slots of the table that orders shingles by how common they are.
SLOTS = 1 << 21
_GAP = np.uint64(0x9E3779B97F4A7C15)
_CELL = np.uint64(0xC2B2AE3D27D4EB4F)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def weighted(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) and how often each stands."""
    order = np.lexsort((h, rows))
    r, e = rows[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return r[at], e[at], np.diff(np.append(at, len(r))).astype(np.float64)


def dart_signatures(rows: np.ndarray, h: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of weighted elements; rows without elements stay 0."""
    best = np.full(n * k, np.inf)
    sig = np.zeros(n * k, np.uint64)
    total = np.bincount(rows, weights, n)
    reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        pick = np.flatnonzero(todo[rows])
        cells = np.ceil(weights[pick]).astype(np.int64)
        owner = np.repeat(pick, cells)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        row, room = rows[owner], weights[owner] - index
        with np.errstate(over="ignore"):
            state = mix(h[owner] + index.astype(np.uint64) * _CELL)
        rank, limit = np.zeros(len(owner)), reach[row]
        while len(state):
            with np.errstate(over="ignore"):
                state = state + _GAP
            dart = mix(state)
            rank = rank - np.log(_uniform(dart))
            live = rank <= limit
            state, rank, limit, row, room, dart = state[live], rank[live], limit[live], row[live], room[live], dart[live]
            aim = mix(dart ^ _CELL)
            hit = np.ones(len(dart), bool) if room.size == 0 or room.min() >= 1 else _uniform(mix(dart ^ _GAP)) < room
            at = row[hit] * k + (aim[hit] % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, rank[hit])
            won = best[at] == rank[hit]
            sig[at[won]] = dart[hit][won]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return sig.reshape(n, k)


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, text: Column, bands: int = BANDS, depth: int = DEPTH, size: int = SIZE, by_count: bool = False) -> DataFrame:
    """(key, id, bands) of every row: one hash for each band of its signature, none for a text without words."""

    def scan(batches):
        for batch in batches:
            parts = [np.zeros((0, bands), np.uint64)]
            full = []
            for w in words(batch.column(2), 2 * PIECE):
                rows, h, count = weighted(*shingles(w, size))
                n = w.hi - w.lo
                sig = dart_signatures(rows, h, count if by_count else np.ones(len(h)), n, bands * depth)
                band = np.arange(bands, dtype=np.uint64)[None, :] * _CELL
                folded = np.broadcast_to(band, (n, bands)).copy()
                with np.errstate(over="ignore"):
                    for d in range(depth):
                        folded = mix(folded * _GAP + sig[:, d::depth])
                parts.append(folded[np.diff(w.at) > 0])
                full.append(np.diff(w.at) > 0)
            full = np.concatenate(full) if full else np.zeros(0, bool)
            at = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "id", "bands"])

    return docs.select(text_key(text).alias("key"), F.col("id"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(scan, "key binary, id long, bands array<long>")


def _similar(batches, size, least):
    """Of rows (a, b, text of a, text of b), the (a, b) whose shingle sets reach ``least``."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sides = []
            for column in (2, 3):
                rs, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for w in words(part.column(column)):
                    r, h = shingles(w, size)
                    rs.append(r + w.lo)
                    hs.append(h)
                sides.append(weighted(np.concatenate(rs), np.concatenate(hs))[:2])
            (ra, ha), (rb, hb) = sides
            r, _, both = weighted(np.concatenate([ra, rb]), np.concatenate([ha, hb]))
            union = np.bincount(r, minlength=part.num_rows)
            shared = np.bincount(r[both > 1], minlength=part.num_rows)
            keep[lo:lo + part.num_rows] = (union > 0) & (shared >= least * union - 1e-9)
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``texts`` is (node, text) with one row a node."""
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _similar(batches, size, least), "a long, b long")


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts hold a shingle of each of SLOTS hash slots: an ordering aid of fixed size."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for w in words(b.column(0)):
                _, h, _ = weighted(*shingles(w, size))
                total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo:lo + (1 << 16)]), pa.array(total[at[lo:lo + (1 << 16)]])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def across_components(texts: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of ``texts`` (node, c, text) of different ``c`` that can be similar: no similar pair is missed.

    Each text's shingles are put in one global order, rare ones first. Two texts of Jaccard similarity ``least`` share a shingle
    so early that enough of both is left behind it; only such meetings become pairs (prefix and position filters).
    """
    order = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, size))

    def prefixes(batches):
        for b in batches:
            node, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            for w in words(b.column(2)):
                rows, h, _ = weighted(*shingles(w, size))
                n = np.bincount(rows, minlength=w.hi - w.lo)
                sort = np.lexsort((h, order.value[(h % np.uint64(SLOTS)).astype(np.int64)], rows))
                rows, h = rows[sort], h[sort]
                place = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
                keep = place <= n[rows] * (1 - least) + 1e-9
                rows, h, place = rows[keep], h[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[w.lo + rows]), pa.array(c[w.lo + rows]), pa.array(n[rows]), pa.array(n[rows] - place)], names=["h", "node", "c", "n", "left"])

    keys = cut_lineage(texts.select("node", "c", "text").mapInArrow(prefixes, "h long, node long, c long, n long, left long"))
    a, b = keys.alias("x"), keys.alias("y")
    enough = least / (1 + least)
    met = F.expr(f"x.h = y.h AND x.c < y.c AND least(x.left, y.left) >= {enough!r} * (x.n + y.n) - 1e-6")
    return a.join(b, met).select(F.expr("greatest(x.node, y.node)").alias("a"), F.expr("least(x.node, y.node)").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST, bands: int = BANDS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(marks, links) of the near-duplicate classes of ``docs``.

    ``marks`` has one row (key, class_id, keeper) for each distinct text: ``class_id`` is the smallest id of all rows of
    its class, ``keeper`` says whether the class keeps this text (the one of the smallest id; null ids come
    last, then the smallest key). Exact copies share a key. Texts whose sets of ``size``-word shingles have a Jaccard similarity of
    ``least`` or more are linked, and classes are the connected components. Null texts count as empty; texts
    without words link with nothing but their exact copies.

    A bucket's texts are compared with its best connected one. Texts of buckets in which more than one component is left go on to
    an exact search across components, so no group is ever expanded into all its pairs.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    sig = signatures(rows, F.col("t"), bands, depth, size)
    distinct = sig.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    distinct = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("node"), "*"))
    buckets = distinct.select("node", F.explode("bands").alias("band"))
    many = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(buckets.join(many, "band"))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "node").select("band", "node", F.struct(F.col("degree"), (-F.col("node")).alias("m")).alias("r"))
    pivots = ranked.groupBy("band").agg((-F.max("r")["m"]).alias("pivot"))
    pairs = members.join(pivots, "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    needed = degree.select("node").join(distinct.select("node", "key"), "node")
    texts = rows.select(text_key(F.col("t")).alias("key"), F.col("t").alias("text")).join(needed, "key").groupBy("node").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts)
    links = cut_lineage(verified(pairs, texts, size, least))
    found = components(links)
    left = members.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    split = left.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    open_ = cut_lineage(left.join(split, "band", "left_semi").select("node", "c").distinct().join(texts, "node"))
    more = cut_lineage(verified(across_components(open_, size, least), texts, size, least))
    if more.take(1):
        links = links.unionAll(more)
        found = components(links)
    nodes = distinct.select("node", "key", "id").join(found, "node", "left").select("key", "id", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("key").alias("key"))).alias("f")
    heads = nodes.groupBy("component").agg(first)
    marks = nodes.join(heads, "component").select("key", F.col("f.id").alias("class_id"), (F.col("key") == F.col("f.key")).alias("keeper"))
    return marks, links


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row (doc_id, class_id, kept) for each row of ``docs``; of each class exactly one row is kept.

    The kept row has the class's smallest id; of equal rows one is kept.
    """
    marks, _ = near_duplicates(docs, doc_id, text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"))
    one = Window.partitionBy("doc_id", "key").orderBy(F.lit(0))
    got = rows.withColumn("_n", F.row_number().over(one)).join(marks, "key")
    return got.select("doc_id", "class_id", (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_n") == 1)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``classes`` keeps, all columns."""
    marks, _ = near_duplicates(docs, doc_id, text, **options)
    key, stay_, class_ = fresh(docs.columns, "_key", "_stay", "_class")
    stay = cut_lineage(marks.where("keeper").select(F.col("key").alias(stay_), F.col("class_id").alias(class_)))
    rows = docs.select("*", text_key(F.col(text)).alias(key))
    rows = rows.join(stay, (F.col(key) == F.col(stay_)) & F.col(doc_id).eqNullSafe(F.col(class_)), "left_semi")
    return rows.dropDuplicates([doc_id, key]).drop(key)
