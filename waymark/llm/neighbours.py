"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree halves a sample at hyperplanes between two of its vectors until leaves are small; every vector of the table then falls into one
leaf of each tree. A query walks all trees through one priority queue whose keys are the distances to the hyperplanes that separate it
from a subtree, and stops where that distance passes a share of the distance to its k-th neighbour within the sample. The share is
the one that finds RECALL of the sample's own neighbours, so effort follows the data: clustered vectors need few leaves, evenly spread
ones many. Leaf candidates are ranked by their exact cosine, leaf block by query block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.ranks import top_per_group
from waymark.session import cut_lineage, parallelism

K = 5
#: Trees; vectors the forest is fitted on, at most; of these in one leaf, at most.
TREES, SAMPLE, LEAF = 8, 65_536, 128
#: Share of the sample's own neighbours that the stopping rule must reach, over TRIALS vectors of the sample.
RECALL, TRIALS = 0.97, 512
#: Vectors of one leaf block, queries of one query block.
MEMBERS, ASKING = 2048, 512


def unit(column: pa.Array, wide: bool) -> np.ndarray:
    """Unit rows in double precision of a binary column of floats (doubles if ``wide``), safe for very large and small parts."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float64 if wide else np.float32)
    m = raw.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=0)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@dataclass
class Tree:
    planes: np.ndarray  # one unit normal a node
    cuts: np.ndarray  # a vector goes right where its projection is above
    kids: np.ndarray  # left and right: a node, or -1 - leaf
    leaves: int

    def leaf_of(self, m: np.ndarray) -> np.ndarray:
        if not len(self.planes):
            return np.zeros(len(m), np.int32)
        side = (m @ self.planes.T > self.cuts).astype(np.int8)
        node, act = np.zeros(len(m), np.int64), np.arange(len(m))
        while len(act):
            node[act] = self.kids[node[act], side[act, node[act]]]
            act = act[node[act] >= 0]
        return (-1 - node).astype(np.int32)


def fit_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Halve at the median between two vectors of the part; a part that no plane divides stays one leaf."""
    planes, cuts, kids, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        part, parent, side = todo.pop()
        right = None
        if len(part) > leaf:
            for _ in range(8):
                a, b = sample[rng.choice(part, 2, replace=False)]
                size = np.linalg.norm(a - b)
                if size == 0:
                    continue
                at = sample[part] @ ((a - b) / size)
                cut = np.median(at)
                right = at > cut
                if right.any():
                    break
                right = None
        if right is None:
            me = -1 - leaves
            leaves += 1
        else:
            me = len(planes)
            planes.append((a - b) / size)
            cuts.append(cut)
            kids.append([0, 0])
            todo += [(part[~right], me, 0), (part[right], me, 1)]
        if parent >= 0:
            kids[parent][side] = me
    width = sample.shape[1]
    return Tree(np.array(planes).reshape(-1, width), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), leaves)


def search(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, radius: float, k: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, as long as the separating distance is at most ``radius`` or no tree has shown ``k`` vectors."""
    margins = [t.planes @ q - t.cuts for t in forest]
    heap = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(forest)]
    out, shown = [], np.zeros(len(forest), np.int64)
    while heap:
        far, t, node = heapq.heappop(heap)
        if far > radius and shown.max() >= k:
            break
        while node >= 0:
            m = margins[t][node]
            left, right = forest[t].kids[node].tolist()
            near, other = (right, left) if m > 0 else (left, right)
            heapq.heappush(heap, (max(far, abs(m)), t, other))
            node = near
        out.append((t, -1 - node))
        shown[t] += sizes[t][-1 - node]
    return out


def least_found(forest: list[Tree], homes: list[np.ndarray], seen: list[tuple[int, int]], cos: np.ndarray, k: int) -> float:
    """The k-th best of the sample's cosines ``cos`` within the leaves ``seen``: no less is among the k best found."""
    met = np.zeros(len(cos), bool)
    for t, tree in enumerate(forest):
        mark = np.zeros(tree.leaves, bool)
        mark[[x for u, x in seen if u == t]] = True
        met |= mark[homes[t]]
    own = cos[met]
    return float(np.partition(own, len(own) - k)[len(own) - k]) - 1e-9 if len(own) >= k else -2.0


def _separations(tree: Tree, q: np.ndarray) -> np.ndarray:
    """Key under which the queue reaches each leaf of ``tree`` for each row of ``q``."""
    out = np.zeros((len(q), tree.leaves))
    if not len(tree.planes):
        return out
    margin = q @ tree.planes.T - tree.cuts
    todo = [(0, np.zeros(len(q)))]
    while todo:
        node, far = todo.pop()
        if node < 0:
            out[:, -1 - node] = far
            continue
        m = margin[:, node]
        left, right = tree.kids[node].tolist()
        todo += [(left, np.where(m > 0, np.maximum(far, m), far)), (right, np.where(m > 0, far, np.maximum(far, -m)))]
    return out


def reach(cos: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest of the sample for each row of cosines; without k vectors everything is near."""
    n = cos.shape[1]
    if n < k:
        return np.full(len(cos), np.inf)
    return np.sqrt(np.maximum(2 - 2 * np.partition(cos, n - k, axis=1)[:, n - k], 0)) + 1e-9


def fit_forest(sample: np.ndarray, k: int, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, seed: int = 5) -> tuple[list[Tree], float]:
    """The trees, and the share of a query's reach at which ``recall`` of the sample's k nearest are found."""
    rng = np.random.default_rng(seed)
    forest = [fit_tree(sample, leaf, rng) for _ in range(trees)]
    trial = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    homes = [t.leaf_of(sample) for t in forest]
    shares = []
    for lo in range(0, len(trial), 32):  # a few at a time: their cosines with the whole sample are held
        q = trial[lo:lo + 32]
        cos = q @ sample.T
        far = reach(cos, k)
        if not np.isfinite(far).all():
            return forest, np.inf
        near = np.argpartition(cos, len(sample) - k, axis=1)[:, len(sample) - k:]
        needed = np.full(near.shape, np.inf)
        for t, home in zip(forest, homes, strict=True):
            needed = np.minimum(needed, np.take_along_axis(_separations(t, q), home[near], axis=1))
        shares.append(needed / far[:, None])
    return forest, float(np.quantile(np.concatenate(shares), recall, method="higher")) if shares else np.inf


def _sound(name: str) -> Column:
    """Not empty, without null or non-finite parts, not zero."""
    v = F.col(name)
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def keyed_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, bool]:
    """(id, vec, key) of the rows that take part, and whether their parts are doubles."""
    wide = vectors.schema[embedding].dataType.elementType.typeName() != "float"
    kind = "array<double>" if wide else "array<float>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    return rows.where(_sound("vec")).withColumn("key", F.struct(F.xxhash64("vec").alias("x"), F.hash("vec").alias("h"), F.size("vec").alias("dim"))), wide


def distinct_vectors(rows: DataFrame, wide: bool, k: int) -> DataFrame:
    """(node, key, dim, vec, ids): each vector once, as bytes, with its ``k`` smallest ids."""
    kind = np.float64 if wide else np.float32
    # A vector with any number of copies sends k rows of each task at most.
    few = top_per_group(rows, ["key"], [F.col("id")], k, "place")
    one = few.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    one = one.select(F.monotonically_increasing_id().alias("node"), "key", F.col("key.dim").alias("dim"), "ids", "vec")

    def pack(batches):
        for b in batches:
            raw = pa.array([np.array(x, kind).tobytes() for x in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], raw], names=["node", "key", "dim", "ids", "vec"])

    return cut_lineage(one.mapInArrow(pack, "node long, key struct<x: long, h: int, dim: int>, dim int, ids array<long>, vec binary"))


def _ranked(wide: bool, k: int):
    """Of rows ordered by (tree, leaf, block, side): the members of a block are held (at most about MEMBERS), queries stream past them."""

    def run(batches):
        at, ids, m, whole = None, [], [], None
        for b in batches:
            group = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            side, node, bound = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy()
            u = unit(b.column(6), wide)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1 if len(group) else []
            q_out, n_out, s_out = [], [], []
            for part in np.split(np.arange(len(group)), cuts):
                if not len(part):
                    continue
                if at != (now := tuple(group[part[0]])):
                    at, ids, m, whole = now, [], [], None
                if side[part[0]] == 0:
                    ids.append(node[part])
                    m.append(u[part])
                    continue
                if not m:
                    continue
                if whole is None:
                    whole = (np.concatenate(ids), np.concatenate(m))
                cos = u[part] @ whole[1].T
                least = bound[part]
                if cos.shape[1] > k:
                    least = np.maximum(least, np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k])
                i, j = np.nonzero(cos >= least[:, None])
                q_out.append(node[part][i])
                n_out.append(whole[0][j])
                s_out.append(cos[i, j])
            flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(flat(q_out, np.int64)), pa.array(flat(n_out, np.int64)), pa.array(flat(s_out, np.float64))], names=["q", "node", "score"])

    return run


def leaf_hits(nodes: DataFrame, asking: DataFrame, wide: bool, k: int, trees: int = TREES, most: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(q, node, score) of the ``k`` best of each leaf block that a query reaches, for vectors of one length; the queries themselves are among them.

    The forest is fitted on ``most`` vectors at the most; it and that sample are what is broadcast.
    """
    spark = nodes.sparkSession
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("vec").toArrow().column("vec").combine_chunks()
    sample = unit(picked, wide)
    forest, share = fit_forest(sample, k, trees, leaf, recall)
    homes = [t.leaf_of(sample) for t in forest]
    sizes = [np.bincount(h, minlength=t.leaves) for h, t in zip(homes, forest, strict=True)]
    send = spark.sparkContext.broadcast((forest, share, sample, homes, sizes))
    # A leaf holds about its share of the sample of all vectors; its members are dealt into blocks of bounded size.
    blocks = max(1, -(-nodes.count() * leaf // (max(len(sample), 1) * MEMBERS)))
    names = ["tree", "leaf", "block", "side", "node", "bound", "vec"]
    schema = "tree int, leaf int, block int, side int, node long, bound double, vec binary"

    def members(batches):
        forest = send.value[0]
        for b in batches:
            m, n = unit(b.column(1), wide), b.num_rows
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(tree.leaf_of(m)), b.column(2), pa.array(np.zeros(n, np.int32)), b.column(0), pa.array(np.zeros(n)), b.column(1)], names=names)

    def visits(batches):
        forest, share, sample, homes, sizes = send.value
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                part = b.slice(lo, 32)
                m = unit(part.column(1), wide)
                cos = m @ sample.T
                seen = [search(forest, sizes, q, share * d, k) for q, d in zip(m, reach(cos, k), strict=True)]
                cos = np.array([least_found(forest, homes, s, c, k) for s, c in zip(seen, cos, strict=True)])
                row = np.repeat(np.arange(len(m)), [len(x) for x in seen])
                at = np.array([x for s in seen for x in s], np.int32).reshape(-1, 2)
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), part.column(0).take(pa.array(row)), pa.array(cos[row]), part.column(1).take(pa.array(row))], names=names)

    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    inside = nodes.select("node", "vec", block.alias("block")).mapInArrow(members, schema)
    asked = asking.select("node", "vec").mapInArrow(visits, schema)
    if blocks > 1:
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    group = ["tree", "leaf", "block"]
    rows = inside.unionByName(asked.select(*names)).repartition(parallelism(spark), *group).sortWithinPartitions(*group, "side")
    return rows.mapInArrow(_ranked(wide, k), "q long, node long, score double")


def nearest(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, **forest) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest by cosine to each row where ``asks`` holds, its own row left out.

    Nearest first, equal cosines by smaller id. Rows whose id is null, or whose vector is null, empty, zero or holds null or non-finite parts,
    take no part; vectors of another length are not compared. Rows with one id are rows of their own. Copies of a vector are searched once. Fewer
    than ``k`` other rows: all of them; none: no row for that query. Further columns are not read.
    """
    spark = vectors.sparkSession
    rows, wide = keyed_vectors(vectors, vec_id, embedding)
    nodes = distinct_vectors(rows, wide, k + 1)
    asked = keyed_vectors(vectors.where(asks), vec_id, embedding)[0].select("id", "key").join(nodes.select("key", F.col("node").alias("q")), "key").select("id", "q")
    asked = cut_lineage(asked)
    own = asked.select(F.col("q").alias("node")).distinct()
    hits = spark.createDataFrame([], "q long, node long, score double")
    for r in nodes.select("dim").distinct().collect():  # a table of embeddings has one or a few lengths
        mine = nodes.where(F.col("dim") == r["dim"])
        hits = hits.unionByName(leaf_hits(mine, mine.join(own, "node", "left_semi"), wide, k + 1, **forest))
    best = hits.groupBy("q", "node").agg(F.max("score").alias("score"))  # a vector may be met in several trees
    copies = best.join(nodes.select("node", "ids"), "node").select("q", "node", "score", F.explode("ids").alias("vec_id"))
    few = top_per_group(copies, ["q"], [F.col("score").desc(), F.col("vec_id")], k + 1, "place")
    lists = few.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "node"))).alias("found"))
    item = F.filter("found", lambda x: (x["vec_id"] == F.col("id")) & (x["node"] == F.col("q")))
    mine = F.coalesce(F.get(item, F.lit(0))["place"], F.lit(-1))
    others = F.slice(F.filter("found", lambda x: x["place"] != F.col("mine")), 1, k)
    out = asked.join(lists, "q").withColumn("mine", mine).select("id", F.posexplode(others).alias("rank", "x"))
    return out.select(F.col("id").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
