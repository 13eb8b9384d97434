"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane bits, vectors are ordered by that key, and each
is compared with a bounded window of neighbours. Close pairs share long key prefixes in some pass, so they meet; all
verified pairs are united. The links inside each resulting component are then counted exactly, block against block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import components
from waymark.session import cut_lineage, parallelism

LEAST = 0.95
#: A pair of cosine 0.95 shares one bit with probability 0.899, so b bits with 0.899^b; with n vectors and windows of w
#: it is missed by all passes with probability (1 - 0.899^log2(n / w))^PASSES: 1e-6 at 50,000 vectors, 0.02 at 10^8.
PASSES, WINDOW, BITS = 24, 256, 64
#: Vectors whose median along each hyperplane balances its bits, at most.
SAMPLE = 4096
#: Vectors of one block of the exact count.
BLOCK = 512


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision of a list or binary column."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        m = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)
    else:
        m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _keys(m: np.ndarray, planes: np.ndarray, middle: np.ndarray, passes: int) -> np.ndarray:
    """passes x n sort keys: BITS hyperplane bits each, the first one highest, as signed longs."""
    bits = (m @ planes > middle).reshape(len(m), passes, BITS)
    power = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    key = (bits * power).sum(axis=2, dtype=np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64).T


class _Sets:
    """Disjoint sets over the nodes one task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _windows(width: int, window: int, least: float):
    """Of (pass, key, node, vector) in order: a spanning set of the links among neighbours."""

    def run(batches):
        sets = _Sets()
        old_pass, nodes, old = None, np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            passes = b.column(0).to_numpy()
            ids, m = b.column(2).to_numpy(), _matrix(b.column(3), width)
            a_out, b_out = [], []
            for lo in range(0, len(ids), window):
                for p in np.unique(passes[lo:lo + window]):
                    at = lo + np.flatnonzero(passes[lo:lo + window] == p)
                    if p != old_pass:
                        old_pass, nodes, old = p, np.zeros(0, np.int64), np.zeros((0, width))
                    near, mine = np.concatenate([nodes, ids[at]]), m[at]
                    all_ = np.concatenate([old, mine])
                    i, j = np.nonzero(mine @ all_.T >= least)
                    i, j = ids[at][i], near[j]
                    keep = i > j
                    for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                        if sets.join(x, y):
                            a_out.append(x)
                            b_out.append(y)
                    nodes, old = near[-window:], all_[-window:]
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _sound(v: Column) -> Column:
    """Not null, without null or non-finite parts, not zero."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; distinct: node, key, id, copies, dim, vec). Rows whose vector can link with nothing have a null key."""
    v = F.col(embedding).cast("array<float>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(_sound(v), v).alias("vec"))
    key = F.when(F.col("vec").isNotNull(), F.struct(F.xxhash64("vec").alias("x"), F.hash("vec").alias("h"), F.size("vec").alias("dim")))
    rows = rows.withColumn("key", key)
    one = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    return rows.drop("vec"), cut_lineage(one.select(F.monotonically_increasing_id().alias("node"), "key", "id", "copies", F.col("key.dim").alias("dim"), "vec"))


def pass_links(distinct: DataFrame, width: int, passes: int = PASSES, window: int = WINDOW, least: float = LEAST, seed: int = 11) -> DataFrame:
    """(a, b): nodes of dimension ``width`` linked in some pass, as a spanning set for each task."""
    mine = distinct.where(F.col("dim") == width).select("node", "vec")
    sample = mine.orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()
    m = np.array(sample["vec"].tolist(), np.float64).reshape(-1, width)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    planes = np.random.default_rng(seed).standard_normal((width, passes * BITS))
    middle = np.median(m @ planes, axis=0)
    send = mine.sparkSession.sparkContext.broadcast((planes.astype(np.float32), middle.astype(np.float32)))

    def keyed(batches):
        planes, middle = send.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                unit = _matrix(part.column(1), width)
                keys = _keys(unit.astype(np.float32), planes, middle, passes)
                raw = pa.array([x.tobytes() for x in part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)], pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, p, np.int32)), pa.array(keys[p]), part.column(0), raw], names=["pass", "key", "node", "vec"])

    rows = mine.mapInArrow(keyed, "pass int, key long, node long, vec binary")
    rows = rows.repartitionByRange(parallelism(mine.sparkSession), "pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    return rows.mapInArrow(_windows(width, window, least), "a long, b long")


def link_counts(members: DataFrame, width: int, least: float = LEAST) -> DataFrame:
    """(node, n): copies of other vectors of the same component with cosine ``least`` or more.

    ``members`` is (component, node, copies, vec). A component is dealt into blocks of about BLOCK vectors, and each pair of blocks is one
    row of work that sends back sums only.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK)
    rows = members.join(sizes, "component").select("component", blocks.alias("k"), F.pmod(F.xxhash64("node"), blocks).alias("block"), F.struct("node", "copies", "vec").alias("v"))
    packed = rows.groupBy("component", "k", "block").agg(F.collect_list("v").alias("left"))
    packed = cut_lineage(packed)
    other = packed.select("component", F.col("block").alias("block2"), F.col("left").alias("right"))
    pairs = packed.withColumn("block2", F.explode(F.sequence("block", F.col("k") - 1))).join(other, ["component", "block2"])
    pairs = pairs.select("left", F.when(F.col("block") != F.col("block2"), F.col("right")).alias("right"))

    def unpack(items):
        return (np.array([x["node"] for x in items], np.int64), np.array([x["copies"] for x in items], np.int64), np.array([x["vec"] for x in items], np.float64).reshape(-1, width))

    def count(batches):
        for b in batches:
            nodes, sums = [], []
            for r in range(b.num_rows):
                ids, n, m = unpack(b.column(0)[r].as_py())
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                other = b.column(1)[r].as_py()
                if other is None:
                    hit = m @ m.T >= least
                    np.fill_diagonal(hit, False)
                    nodes.append(ids)
                    sums.append(hit @ n)
                else:
                    ids2, n2, m2 = unpack(other)
                    m2 /= np.linalg.norm(m2, axis=1, keepdims=True)
                    hit = m @ m2.T >= least
                    nodes += [ids, ids2]
                    sums += [hit @ n2, hit.T @ n]
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(nodes)), pa.array(flat(sums))], names=["node", "n"])

    return pairs.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing; vectors of different
    length never link. Exact copies are one node and count each other; every row counts, whatever its id. ``component_id`` is
    the smallest id reachable, ``kept`` whether it is the row's own.
    """
    rows, distinct = distinct_vectors(vectors, vec_id, embedding)
    found, counts = None, None
    for r in distinct.select("dim").distinct().collect():  # a table of embeddings has one or a few lengths
        links = cut_lineage(pass_links(distinct, r["dim"], passes, window, least))
        some = cut_lineage(components(links))
        members = distinct.join(some, "node").select("component", "node", "copies", "vec")
        n = link_counts(members, r["dim"], least)
        found = some if found is None else found.unionAll(some)
        counts = n if counts is None else counts.unionAll(n)
    nodes = distinct.select("node", "key", "id", "copies")
    if found is None:
        nodes = nodes.withColumn("component", F.col("node")).withColumn("n", F.lit(0).cast("long"))
    else:
        nodes = nodes.join(found, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    marks = nodes.join(heads, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"), "component_id")
    out = rows.join(marks, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
