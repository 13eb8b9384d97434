"""Similarity search and descriptor matching over blocks of vectors.

Rows are packed into blocks of bounded size by a hash of their id, and each pair of
blocks is one matrix product in NumPy of which only the best hits are kept.
No pair of single rows is ever materialized, and a crowded map or image just has
more blocks. Map images are grouped around pivots, so a search leaves out the groups
that the triangle inequality shows to be too far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import with_row
from waymark.session import cut_lineage, parallelism

BLOCK = 2048
#: Pivots of a map index, at most: the plan of a search has a row for each two of them.
PIVOTS = 64
#: Queries that a task holds while images stream past, at most, and the bytes they may take; images that stream past one team.
TEAM, TEAM_BYTES, SLICE = 1 << 15, 1 << 26, 1 << 18
#: Stands for a null id or map key in arrays; last in order, as null is.
NONE = np.iinfo(np.int64).max


def pack(df: DataFrame, keys: Sequence[str], id_col: str, vec: str, extra: str | None = None, block: int = BLOCK) -> DataFrame:
    """keys, blk, nblk, ids, extras, flat: the vectors of each block as one float array."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nblk"))
    rows = df.join(sizes, keys) if keys else with_row(df, sizes)
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(id_col), F.col("nblk")).cast("int"))
    member = F.struct(F.col(id_col).alias("i"), F.col(extra or id_col).alias("e"), F.col(vec).cast("array<float>").alias("v"))
    packed = rows.groupBy(*keys, "nblk", "blk").agg(F.collect_list(member).alias("m"))
    return packed.select(*keys, "blk", "nblk", F.col("m.i").alias("ids"), F.col("m.e").alias("extras"), F.flatten("m.v").alias("flat"))


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.maximum(size, 1e-12)


def best_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best scores; equal scores go to the lower id."""
    n, m = scores.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero(scores >= cut)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


class Best:
    """The ``k`` best images so far of each of a team's queries; equal scores go to the lower id."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit, k
        self.score = np.full((len(ids), k), -np.inf)
        self.image = np.full((len(ids), k), NONE)
        self.extra = np.zeros((len(ids), k), np.int64)

    def offer(self, at: slice, ids: np.ndarray, extras: np.ndarray, unit: np.ndarray, skip_self: bool) -> None:
        """Compare the queries ``at`` with some images and keep what is among a query's best."""
        scores = self.unit[at] @ unit.T
        if skip_self:
            scores[(self.ids[at][:, None] == ids[None, :]) & (ids != NONE)[None, :]] = -np.inf
        r, c = best_columns(scores, ids, self.k) if np.isinf(self.score[at, -1]).any() else np.nonzero(scores >= self.score[at, -1:])
        s = scores[r, c]
        ok = np.isfinite(s) & (s >= self.score[at, -1][r])
        r, c, s = r[ok], c[ok], s[ok]
        if not len(r):
            return
        rows = np.unique(r)
        old = rows + at.start
        row = np.concatenate([np.repeat(rows, self.k), r])
        score = np.concatenate([self.score[old].ravel(), s])
        image = np.concatenate([self.image[old].ravel(), ids[c]])
        extra = np.concatenate([self.extra[old].ravel(), extras[c]])
        order = np.lexsort((image, -score, row))
        begin = np.searchsorted(row[order], rows)
        top = order[begin[:, None] + np.arange(self.k)]
        self.score[old], self.image[old], self.extra[old] = score[top], image[top], extra[top]

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(self.score))
        cols = (self.ids[r], self.extra[r, c], self.image[r, c], self.score[r, c])
        return pa.RecordBatch.from_arrays([pa.array(v, mask=v == NONE) for v in cols], names=["query", "map_key", "image", "score"])


def _topk(k: int, skip_self: bool):
    """Rows of a team (q_cell, team, slice) in order: first its query blocks (kind 0), then the image blocks that some of them visit."""

    def units(flat, n: int) -> np.ndarray:
        return unit_rows(matrix(flat.values.to_numpy(zero_copy_only=False), n))

    def longs(flat) -> np.ndarray:
        return flat.values.fill_null(NONE).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, best, spans = None, [], None, {}
        for b in batches:
            for i in range(b.num_rows):
                now = tuple(b.column(j)[i].as_py() for j in range(3))
                if now != at:
                    if best is not None:
                        yield best.rows()
                    at, blocks, best, spans = now, [], None, {}
                ids = longs(b.column(5)[i])
                unit = units(b.column(7)[i], len(ids))
                if b.column(3)[i].as_py() == 0:
                    blocks.append((b.column(4)[i].as_py()[0], ids, unit))
                    continue
                if best is None:
                    if not blocks:
                        continue
                    ends = np.cumsum([0] + [len(q[1]) for q in blocks]).tolist()
                    spans = {q[0]: slice(lo, hi) for q, lo, hi in zip(blocks, ends[:-1], ends[1:], strict=True)}
                    best = Best(np.concatenate([q[1] for q in blocks]), np.concatenate([q[2] for q in blocks]), k)
                    blocks = []
                extras = longs(b.column(6)[i])
                for part in _joined(sorted((spans[q] for q in b.column(4)[i].as_py() if q in spans), key=lambda p: p.start), BLOCK):
                    best.offer(part, ids, extras, unit, skip_self)
        if best is not None:
            yield best.rows()

    return run


def _joined(spans: list[slice], size: int) -> Iterator[slice]:
    """Neighbouring spans put together, cut into pieces of at most ``size`` rows."""
    k = 0
    while k < len(spans):
        lo, hi = spans[k].start, spans[k].stop
        while k + 1 < len(spans) and spans[k + 1].start == hi:
            k += 1
            hi = spans[k].stop
        k += 1
        for i in range(lo, hi, size):
            yield slice(i, min(i + size, hi))


class MapIndex(NamedTuple):
    """Map images in blocks around pivots: each cell holds the images nearest to one pivot, no farther from it than its radius."""

    blocks: DataFrame  # cell, blk, ids, extras, flat
    cells: DataFrame  # cell, nblk, radius
    pivots: np.ndarray  # unit rows


def _angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ v.T, -1.0, 1.0))


def choose_pivots(maps: DataFrame, most: int = PIVOTS, seen: int = 4096) -> np.ndarray:
    """At most ``most`` unit vectors far from each other, out of ``seen`` images in hash order; both bounds are fixed, so the driver holds a few megabytes."""
    rows = maps.select("image", F.col("vec").cast("array<float>").alias("vec")).orderBy(F.xxhash64("image"), "image").limit(seen).toPandas()
    if not len(rows):
        return np.zeros((0, 1))
    u = unit_rows(np.array(rows["vec"].tolist(), np.float64))
    picked, far = [0], _angles(u, u[:1])[:, 0]
    while len(picked) < most and far.max() > 1e-6:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _angles(u, u[picked[-1:]])[:, 0])
    return u[picked]


def assign_cells(df: DataFrame, id_col: str, pivots: np.ndarray, extra: str | None = None) -> DataFrame:
    """id, extra, vec, cell and the angle to the cell's pivot of every vector."""
    send = df.sparkSession.sparkContext.broadcast(pivots)
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(extra or id_col).cast("long").alias("e"), F.col("vec").cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = send.value
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, 4096):
                part = b.column(2).slice(lo, 4096)
                far = _angles(unit_rows(matrix(part.flatten().to_numpy(zero_copy_only=False), len(part))), pivots)
                cell[lo:lo + len(part)] = far.argmin(axis=1)
                angle[lo:lo + len(part)] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=["i", "e", "v", "cell", "angle"])

    return rows.mapInArrow(run, "i long, e long, v array<float>, cell int, angle double")


def _blocks(placed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of each cell (cell, blk, ids, extras, flat) and the cells (cell, nblk, radius)."""
    cells = cut_lineage(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nblk"), F.max("angle").alias("radius")))
    rows = placed.join(cells.drop("radius"), "cell").withColumn("blk", F.pmod(F.xxhash64("i"), F.col("nblk")).cast("int"))
    packed = rows.groupBy("cell", "blk").agg(F.collect_list(F.struct("i", "e", "v")).alias("m"))
    return packed.select("cell", "blk", F.col("m.i").alias("ids"), F.col("m.e").alias("extras"), F.flatten("m.v").alias("flat")), cells


def index_images(maps: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> MapIndex:
    """The index of map images (map_key, image, vec), written once for any number of searches."""
    chosen = choose_pivots(maps, pivots)
    blocks, cells = _blocks(cut_lineage(assign_cells(maps, "image", chosen, "map_key")) if len(chosen) else maps.select(F.col("image").alias("i"), F.col("map_key").alias("e"), F.col("vec").cast("array<float>").alias("v"), F.lit(0).alias("cell"), F.lit(0.0).alias("angle")), block)
    return MapIndex(cut_lineage(blocks), cells, chosen)


def _between(index: MapIndex, q_cells: DataFrame) -> DataFrame:
    """q_cell, cell, gap: the least angle there can be between a query of one cell and an image of the other; a row for each two pivots in use."""
    angle = _angles(index.pivots, index.pivots)
    n = len(angle)
    apart = index.blocks.sparkSession.createDataFrame([(a, [float(x) for x in angle[a]]) for a in range(n)], "q_cell int, apart array<double>")
    pairs = apart.select("q_cell", F.posexplode("apart").alias("cell", "apart"))
    gap = F.col("apart") - F.col("q_radius") - F.col("radius")
    own = q_cells.select(F.col("cell").alias("q_cell"), F.col("radius").alias("q_radius"))
    return pairs.join(own, "q_cell").join(index.cells.select("cell", "radius"), "cell").select("q_cell", "cell", F.greatest(gap, F.lit(0.0)).alias("gap"))


def search_plan(queries: DataFrame, index: MapIndex, k: int, skip_self: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Query blocks, the cells each query cell searches first, and those it must search besides.

    First come the cells nearest to it that hold ``k`` images (one more if a query's own image does not count). The k-th best found there bounds what
    the rest must beat, so a cell is left out if the triangle inequality puts all its images farther away.
    """
    q_blocks, q_cells = _blocks(cut_lineage(assign_cells(queries, "query", index.pivots)), block)
    q_blocks = cut_lineage(q_blocks.select(F.col("cell").alias("q_cell"), F.col("blk").alias("q_blk"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat")))
    # At most a row for each two pivots.
    between = cut_lineage(_between(index, q_cells))
    sizes = index.blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))
    w = Window.partitionBy("q_cell").orderBy("gap", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = between.join(sizes, "cell").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("before") < k + (1 if skip_self else 0))
    first = cut_lineage(first.select("q_cell", "cell"))
    rest = between.join(first, ["q_cell", "cell"], "left_anti")
    return q_blocks, first, rest


def _visit(q_blocks: DataFrame, index: MapIndex, visits: DataFrame, k: int, skip_self: bool, block: int = BLOCK) -> DataFrame:
    """Best ``k`` of the visited images for each query (visits: q_cell, cell, limited to q_blk if given).

    Query blocks of a cell form teams of at most ``TEAM`` queries. A team is held in arrays while the image blocks that any of its members
    visits stream past, so an image is sent once a team, not once a block, and ``k`` rows a query come back, not ``k`` a pair of blocks. Teams
    that meet very many images are cut into slices of ``SLICE`` images.
    """
    size = max(1, min(TEAM, TEAM_BYTES // (8 * index.pivots.shape[1])) // block)
    images = index.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    slices = -(-images // SLICE) or 1
    on = ["q_cell", "q_blk"] if "q_blk" in visits.columns else ["q_cell"]
    team = F.floor(F.col("q_blk") / size).cast("int").alias("team")
    wants = q_blocks.select("q_cell", "q_blk", team).join(visits, on).groupBy("q_cell", "team", "cell").agg(F.collect_list("q_blk").alias("blks"))
    key = ["q_cell", "team", "slice"]
    part = F.pmod(F.xxhash64("cell", "blk"), F.lit(slices)).cast("int").alias("slice")
    d = index.blocks.select("cell", part, "ids", "extras", "flat").join(wants, "cell")
    d = d.select(*key, F.lit(1).alias("kind"), "blks", "ids", "extras", "flat")
    q = q_blocks.select("q_cell", team, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.array("q_blk").alias("blks"), F.col("q_ids").alias("ids"), F.col("q_ids").alias("extras"), F.col("q_flat").alias("flat"))
    q = q.join(wants.select("q_cell", "team").distinct(), ["q_cell", "team"], "left_semi").select(*d.columns)
    # Teams are few and unequal: more partitions than tasks at once let the scheduler even them out.
    rows = q.unionByName(d).repartition(4 * parallelism(q_blocks.sparkSession), *key).sortWithinPartitions(*key, "kind")
    return rows.mapInArrow(_topk(k, skip_self), "query long, map_key long, image long, score double")


def retrieve_topk(
    queries: DataFrame, maps: DataFrame | None, k: int, skip_self: bool = False, block: int = BLOCK, index: MapIndex | None = None
) -> DataFrame:
    """Best ``k`` images per query by cosine, with their rank overall and within their map; exact, as block pairs are left out only by proof.

    ``queries``: query LONG, vec. ``maps``: map_key LONG, image LONG, vec, or an ``index`` of it. An image that is
    among the best overall has all better images of its map there too, so one global
    list yields both ranks.
    """
    index = index_images(maps, block) if index is None else index
    spark = queries.sparkSession
    if not len(index.pivots):
        hits = spark.createDataFrame([], "query long, map_key long, image long, score double")
    else:
        q_blocks, first, rest = search_plan(queries, index, k, skip_self, block)
        found = cut_lineage(_visit(q_blocks, index, first, k, skip_self, block))
        more = needed_visits(q_blocks, found, rest, k)
        hits = found.unionByName(_visit(q_blocks, index, more, k, skip_self, block))
    overall = Window.partitionBy("query").orderBy(F.desc("score"), "image")
    in_map = Window.partitionBy("query", "map_key").orderBy("rank")
    best = hits.withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= k)
    return best.withColumn("rank_in_map", F.row_number().over(in_map))


def needed_visits(q_blocks: DataFrame, found: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """q_cell, q_blk, cell: the cells in which some query of the block may still have one of its k best."""
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    bound = found.withColumn("_r", F.row_number().over(kth)).filter(F.col("_r") <= k).groupBy("query").agg(
        F.when(F.count("*") == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("score"))))).otherwise(F.lit(4.0)).alias("far")
    )
    owners = q_blocks.select("q_cell", "q_blk", F.explode("q_ids").alias("query")).join(bound, "query", "left")
    limits = owners.groupBy("q_cell", "q_blk").agg(F.max(F.coalesce("far", F.lit(4.0))).alias("far"))
    return limits.join(rest, "q_cell").filter(F.col("gap") <= F.col("far") + 1e-6).select("q_cell", "q_blk", "cell")


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block pair: each left row's best right row and each right row's best left row; one frame a batch."""
    names = ("img1", "img2", "side", "kp", "other", "sim", "conf")
    for pdf in batches:
        out: list[tuple] = []
        for row in pdf.itertuples(index=False):
            a, b = np.asarray(row.a_ids), np.asarray(row.b_ids)
            # Rows in id order, so argmax takes the lowest id among equals.
            oa, ob = np.argsort(a), np.argsort(b)
            a, b = a[oa], b[ob]
            sa, sb = np.asarray(row.a_extras)[oa], np.asarray(row.b_extras)[ob]
            s = matrix(row.a_flat, len(a))[oa] @ matrix(row.b_flat, len(b))[ob].T
            j, i = s.argmax(axis=1), s.argmax(axis=0)
            n = len(a) + len(b)
            out.append((
                np.full(n, row.img1), np.full(n, row.img2), np.r_[np.zeros(len(a), "int32"), np.ones(len(b), "int32")],
                np.r_[a, b], np.r_[b[j], a[i]], np.r_[s[np.arange(len(a)), j], s[i, np.arange(len(b))]], np.r_[sa * sb[j], sb * sa[i]],
            ))
        if out:
            yield pd.DataFrame({n: np.concatenate(v) for n, v in zip(names, zip(*out, strict=True), strict=True)})


def pack_features(feats: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of local features (image, kp_idx, desc, score), ready for any number of matching jobs."""
    return pack(feats, ["image"], "kp_idx", "desc", "score", block)


def pair_blocks(pairs: DataFrame, feats: DataFrame, block: int = BLOCK, right: DataFrame | None = None) -> DataFrame:
    """Block pairs of all listed image pairs. ``feats``: image, kp_idx, desc, score, of both sides or, if packed features
    ``right`` of the second side are given, of the first."""
    left = pack_features(feats, block)

    def side(packed: DataFrame, img: str, p: str) -> DataFrame:
        return packed.select(
            F.col("image").alias(img), F.col("ids").alias(f"{p}_ids"), F.col("extras").alias(f"{p}_extras"), F.col("flat").alias(f"{p}_flat")
        )

    return pairs.select("img1", "img2").join(side(left, "img1", "a"), "img1").join(side(left if right is None else right, "img2", "b"), "img2")


def mutual_matches(pairs: DataFrame, feats: DataFrame, max_matches: int = 2000, block: int = BLOCK, right: DataFrame | None = None) -> DataFrame:
    """Reciprocal nearest descriptors per image pair, the ``max_matches`` most confident of them.

    Confidence is the product of the two keypoint scores.
    """
    near = pair_blocks(pairs, feats, block, right).mapInPandas(
        _nearest, "img1 long, img2 long, side int, kp long, other long, sim double, conf double"
    )
    best = near.groupBy("img1", "img2", "side", "kp").agg(
        F.min(F.struct((-F.col("sim")).alias("n"), F.col("other").alias("o"), "conf")).alias("b")
    ).select("img1", "img2", "side", "kp", F.col("b.o").alias("other"), (-F.col("b.n")).alias("sim"), "b.conf")
    fwd = best.filter("side = 0").select("img1", "img2", F.col("kp").alias("kp1"), F.col("other").alias("kp2"), "sim", "conf")
    bwd = best.filter("side = 1").select("img1", "img2", F.col("other").alias("kp1"), F.col("kp").alias("kp2"))
    mutual = fwd.join(bwd, ["img1", "img2", "kp1", "kp2"])
    w = Window.partitionBy("img1", "img2").orderBy(F.desc("conf"), "kp1", "kp2")
    return mutual.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_matches).select(
        "img1", "img2", "kp1", "kp2", "sim", "conf", "rank"
    )


def match_gate(matches: DataFrame, least: int = 20) -> DataFrame:
    """Matches of the image pairs that have at least ``least`` of them."""
    strong = matches.groupBy("img1", "img2").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return matches.join(strong, ["img1", "img2"])


MatchFn = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def custom_matches(pairs: DataFrame, feats: DataFrame, fn: MatchFn, block: int = BLOCK) -> DataFrame:
    """Matches proposed by ``fn(desc1, desc2) -> (rows, columns, confidence)`` per block pair.

    Proposals of different blocks are settled here: each left keypoint keeps its most confident
    proposal, then each right keypoint the most confident of those. For a matcher that proposes each row's best
    column the result does not depend on the block size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = np.asarray(row.a_ids), np.asarray(row.b_ids)
                oa, ob = np.argsort(a), np.argsort(b)
                i, j, conf = fn(matrix(row.a_flat, len(a))[oa], matrix(row.b_flat, len(b))[ob])
                a, b = a[oa], b[ob]
                yield pd.DataFrame({"img1": row.img1, "img2": row.img2, "kp1": a[i], "kp2": b[j], "conf": conf})

    found = pair_blocks(pairs, feats, block).mapInPandas(run, "img1 long, img2 long, kp1 long, kp2 long, conf double")
    order = F.struct((-F.col("conf")).alias("n"), "kp1", "kp2")
    best = found.groupBy("img1", "img2", "kp1").agg(F.min(order).alias("m")).select("img1", "img2", "m.kp1", "m.kp2", (-F.col("m.n")).alias("conf"))
    best = best.groupBy("img1", "img2", "kp2").agg(F.min(order).alias("m"))
    return best.select("img1", "img2", "m.kp1", "m.kp2", (-F.col("m.n")).alias("conf"))


def similarity_fit(order: np.ndarray, p: np.ndarray, q: np.ndarray, tol: float) -> tuple[int, np.ndarray] | None:
    """Hypothesis and inlier mask of the best planar similarity from ``p`` to ``q``; matches 2h and 2h + 1 in ``order`` give hypothesis h."""
    m = len(order) // 2
    if not m:
        return None
    a, b = order[0:2 * m:2], order[1:2 * m:2]
    u, v = p[b] - p[a], q[b] - q[a]
    l2 = u[:, 0] * u[:, 0] + u[:, 1] * u[:, 1]
    h = np.flatnonzero(l2 > 0)
    if not len(h):
        return None
    a, u, v, l2 = a[h], u[h], v[h], l2[h]
    # Complex quotient v / u: scale and rotation in one.
    re, im = (v[:, 0] * u[:, 0] + v[:, 1] * u[:, 1]) / l2, (v[:, 1] * u[:, 0] - v[:, 0] * u[:, 1]) / l2
    best, mask = (-1, 0), None
    for lo in range(0, len(h), 512):
        s = slice(lo, lo + 512)
        dx, dy = p[None, :, 0] - p[a[s], None, 0], p[None, :, 1] - p[a[s], None, 1]
        ex = re[s, None] * dx - im[s, None] * dy + q[a[s], None, 0] - q[None, :, 0]
        ey = im[s, None] * dx + re[s, None] * dy + q[a[s], None, 1] - q[None, :, 1]
        fit = ex * ex + ey * ey <= tol * tol
        n = fit.sum(axis=1)
        top = int(n.argmax())
        if n[top] > best[0]:
            best, mask = (int(n[top]), int(h[lo + top])), fit[top]
    return best[1], mask


def seed_order(kp1: np.ndarray, kp2: np.ndarray) -> np.ndarray:
    """A fixed shuffle of the matches."""
    return np.lexsort((kp2, kp1, (kp1 * 7919 + kp2 * 104729) % 1000003))


def pack_matches(matches: DataFrame) -> DataFrame:
    """img1, img2 and lists of kp1, kp2, x1, y1, x2, y2: a pair's matches (at most ``max_matches``) as one row."""
    cols = ["kp1", "kp2", "x1", "y1", "x2", "y2"]
    rows = matches.groupBy("img1", "img2").agg(F.collect_list(F.struct(*[F.col(n).cast("long" if n[0] == "k" else "double").alias(n) for n in cols])).alias("m"))
    return rows.select("img1", "img2", *[F.col(f"m.{n}").alias(n) for n in cols])


def each_pair(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row number and the lists of each row of packed matches, as views of the batch's flat columns."""
    flat = [b.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 8)]
    ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]])
    for r, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        yield r, [f[lo:hi] for f in flat]


def similarity_consensus(matches: DataFrame, tol: float = 6.0, least: int = 4) -> DataFrame:
    """Inlier matches of the best planar similarity per image pair.

    ``matches``: img1, img2, kp1, kp2, x1, y1, x2, y2, at most ``max_matches`` a pair. Matches are ordered by a fixed hash;
    the h-th hypothesis is the transform through matches 2h and 2h+1, and all of them are scored, pair by pair in NumPy. Ties go to the
    lower h; pairs with fewer than ``least`` inliers drop out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], [[], [], [], []]
            for r, (kp1, kp2, x1, y1, x2, y2) in each_pair(b):
                fit = similarity_fit(seed_order(kp1, kp2), np.stack([x1, y1], 1), np.stack([x2, y2], 1), tol)
                if fit is None or (n := int(fit[1].sum())) < least:
                    continue
                row.append(np.full(n, r))
                for o, v in zip(out, (kp1[fit[1]], kp2[fit[1]], np.full(n, fit[0]), np.full(n, n)), strict=True):
                    o.append(v)
            row = np.concatenate(row) if row else np.zeros(0, np.int64)
            img = [b.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*img, *(pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out)], names=["img1", "img2", "kp1", "kp2", "h", "inliers"])

    return pack_matches(matches).mapInArrow(run, "img1 long, img2 long, kp1 long, kp2 long, h long, inliers long")
