"""Range joins by grid cell: equi-join on neighbouring cells, then the exact distance test."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_struct(axes: Sequence[Column], size: float, shift: Sequence[int] | None = None) -> Column:
    shift = shift or [0] * len(axes)
    return F.struct(*[(F.floor(a / size) + s).alias(f"c{i}") for i, (a, s) in enumerate(zip(axes, shift))])


def around(cell: str, dims: int, shifts: Sequence[Sequence[int]]) -> Column:
    """Array of the cells at ``shifts`` from a cell."""
    return F.array(*[F.struct(*[(F.col(cell)[f"c{i}"] + s[i]).alias(f"c{i}") for i in range(dims)]) for s in shifts])


def deal(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: tuple[DataFrame, DataFrame], size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_lb`` and ``_rb``: an equi-join on keys, _lb and _rb gives the rows of one on keys alone.

    ``counts``: keys, n of each side. A key of more than ``size`` rows is cut into blocks of about that size; each block of the left side
    meets each of the right side under a key of its own, so a crowded key spreads over as many tasks as it has pairs of
    blocks. Blocks come from a hash of the whole row (rows equal in all columns stay together); a lost task deals alike.
    """
    keys = list(keys)
    wide = [
        n.groupBy(*keys).agg(F.ceil(F.sum("n") / size).cast("int").alias(name)).filter(F.col(name) > 1)
        for n, name in zip(counts, ("_nl", "_nr"))
    ]
    blocks = wide[0].join(wide[1], keys, "full")
    one = F.lit(1)

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*side.columns), F.coalesce(own_n, one)).cast("int")
        meets = F.sequence(F.lit(0), F.coalesce(other_n, one) - 1)
        return side.join(blocks, keys, "left").select(*side.columns, at.alias(own), F.explode(meets).alias(other))

    return dealt(left, "_lb", "_nl", "_rb", "_nr"), dealt(right, "_rb", "_nr", "_lb", "_nl")


def near_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_axes: Sequence[str], right_axes: Sequence[str], radius: float,
    size: int = 4096,
) -> DataFrame:
    """All left/right row pairs of a group within ``radius`` (distance in ``_d``).

    The left side is copied to the neighbouring cells of side ``radius``; the right
    side stays in its own cell. Cells of more than ``size`` rows are joined block by block.
    Column names must not overlap apart from ``keys``. Rows without a position pair with nothing.
    """
    dims = len(left_axes)
    shifts = list(product((-1, 0, 1), repeat=dims))
    on = [*keys, "_cell"]
    own = left.select("*", cell_struct([F.col(a) for a in left_axes], radius).alias("_own"))
    a = own.select("*", F.explode(around("_own", dims, shifts)).alias("_cell")).drop("_own")
    b = right.select("*", cell_struct([F.col(x) for x in right_axes], radius).alias("_cell"))
    # The left side is counted before it is copied.
    na = own.groupBy(*keys, "_own").agg(F.count("*").alias("n"))
    na = na.select(*keys, "n", F.explode(around("_own", dims, shifts)).alias("_cell"))
    nb = b.groupBy(*on).agg(F.count("*").alias("n"))
    a, b = deal(a, b, on, (na, nb), size)
    gap = None
    for p, q in zip(left_axes, right_axes):
        d = (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
        gap = d if gap is None else gap + d
    return a.join(b, [*on, "_lb", "_rb"]).withColumn("_d", F.sqrt(gap)).drop("_cell", "_lb", "_rb")


def nearest_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_axes: Sequence[str], right_axes: Sequence[str],
    radius: float, left_id: Sequence[str], order: Sequence[str],
) -> DataFrame:
    """Nearest right row of each left row closer than ``radius``; ties go to the lowest ``order``."""
    pairs = near_join(left, right, keys, left_axes, right_axes, radius).filter(F.col("_d") < radius)
    take = [c for c in right.columns if c not in keys]
    best = pairs.groupBy(*keys, *left_id).agg(
        F.min_by(F.struct("_d", *take), F.struct("_d", *order)).alias("_b")
    )
    return best.select(*keys, *left_id, F.col("_b._d").alias("dist"), *[F.col(f"_b.{c}").alias(c) for c in take])


def components(points: DataFrame, node: str, axes: Sequence[str], eps: float, max_rounds: int = 60, size: int = 4096) -> DataFrame:
    """Connected components of "within eps" (density clusters with one point per cluster allowed).

    Points are binned into cells of diagonal ``eps``: a cell's points always belong
    together, so only cells are linked. Labels then shrink along links and jump to their
    label's label, which needs about log(rounds) steps; each round is checkpointed. Labels are joined by a shuffle:
    a table just under Spark's broadcast size, sent by every round, would add up in the driver.
    """
    from waymark.session import cut_lineage

    dims = len(axes)
    side = eps / (dims**0.5)
    reach = int(dims**0.5) + 1
    spots = points.select(*axes).distinct()
    # A hair under the diagonal keeps rounding from binning two points more than eps apart.
    side = side * (1 - 1e-12)
    cells = spots.select("*", cell_struct([F.col(a) for a in axes], side).alias("_cell"))
    shifts = [s for s in product(range(-reach, reach + 1), repeat=dims) if s > (0,) * dims]
    offer = cells.select(
        *[F.col(a).alias(f"_l{a}") for a in axes], F.col("_cell").alias("_from"),
        F.explode(F.array(*[
            F.struct(*[(F.col(f"_cell.c{i}") + d).alias(f"c{i}") for i, d in enumerate(s)]) for s in shifts
        ])).alias("_cell"),
    )
    # Only points within eps of the neighbour cell's box can link to it.
    box = None
    for i, a in enumerate(axes):
        lo, hi = F.col(f"_cell.c{i}") * side, (F.col(f"_cell.c{i}") + 1) * side
        d = F.greatest(lo - F.col(f"_l{a}"), F.col(f"_l{a}") - hi, F.lit(0.0))
        box = d * d if box is None else box + d * d
    offer = offer.filter(box <= eps * eps * (1 + 1e-9))
    counts = [side.groupBy("_cell").agg(F.count("*").alias("n")) for side in (offer, cells)]
    offer, targets = deal(offer, cells, ["_cell"], tuple(counts), size)
    gap = None
    for a in axes:
        d = (F.col(f"_l{a}") - F.col(a)) * (F.col(f"_l{a}") - F.col(a))
        gap = d if gap is None else gap + d
    links = (
        offer.join(targets, ["_cell", "_lb", "_rb"]).filter(gap <= eps * eps).select(F.col("_from").alias("a"), F.col("_cell").alias("b")).distinct()
    )
    both = cut_lineage(links.union(links.select("b", "a")))
    label = cut_lineage(cells.select(F.col("_cell").alias("a"), F.col("_cell").alias("root")).distinct())
    for _ in range(max_rounds):
        seen = both.join(label.select(F.col("a").alias("b"), "root").hint("merge"), "b").select("a", "root")
        low = label.select("a", "root").union(seen).groupBy("a").agg(F.min("root").alias("root"))
        jump = low.join(low.select(F.col("a").alias("root"), F.col("root").alias("_next")).hint("merge"), "root").select("a", F.col("_next").alias("root"))
        new = cut_lineage(jump)
        moved = new.join(label.select("a", F.col("root").alias("_was")).hint("merge"), "a").filter(F.col("root") != F.col("_was"))
        label = new
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    placed = points.select("*", cell_struct([F.col(a) for a in axes], side).alias("a")).join(label.hint("merge"), "a").drop("a")
    first = placed.groupBy("root").agg(F.min(node).alias("cluster"))
    return placed.join(first.hint("merge"), "root").drop("root")


def nearest_of_all(
    left: DataFrame, right: DataFrame, own: str, left_axes: Sequence[str], right_axes: Sequence[str], radius: float, order: Sequence[str],
    leaf: int = 32,
) -> DataFrame:
    """own, m: the pair of smallest (distance, ``order``) over all left rows with the same ``own``, if closer than ``radius``.

    Right rows stand in a tree of cells, each a quarter as wide as its parent, with the bounds of the rows in them. Left rows descend it: a cell goes on
    only if it can hold a row as near as the farthest one of some cell is sure to be, so neither crowded cells nor many
    left rows in one of them enumerate their pairs. The depth follows the fullest cell (about ``leaf`` rows along a line in the last ones).
    """
    from waymark.session import cut_lineage

    c = F.col
    dims, keys = len(right_axes), [f"_k{i}" for i in range(len(right_axes))]

    def finite(df: DataFrame, axes: Sequence[str]) -> DataFrame:
        for a in axes:
            df = df.filter(F.abs(c(a).cast("double")) < F.lit(float("inf")))
        return df

    # A hair over the radius keeps rounding from putting a near row two cells away.
    side = radius * (1 + 1e-9)
    spots = cut_lineage(finite(right, right_axes))
    fullest = spots.groupBy(*[F.floor(c(a) / side) for a in right_axes]).count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while leaf * 4**depth < fullest and depth < 10:
        depth += 1
    fine = side / 4**depth
    placed = spots.select("*", *[F.floor(c(a) / fine).alias(k) for a, k in zip(right_axes, keys)])
    low, high = [f"_lo{i}" for i in range(dims)], [f"_hi{i}" for i in range(dims)]
    ends = [f(c(a).cast("double")).alias(n) for a, lo, hi in zip(right_axes, low, high) for f, n in ((F.min, lo), (F.max, hi))]
    boxes = [cut_lineage(placed.groupBy(*keys).agg(*ends))]
    for _ in range(depth):
        up = boxes[0].withColumns({k: F.shiftright(k, 2) for k in keys}).groupBy(*keys)
        boxes.insert(0, cut_lineage(up.agg(*[F.min(n).alias(n) for n in low], *[F.max(n).alias(n) for n in high])))
    at = F.struct(*[F.shiftright(F.floor(c(a) / fine), 2 * depth).alias(f"c{i}") for i, a in enumerate(left_axes)])
    near = finite(left, left_axes).select("*", at.alias("_at"))
    near = near.select(*left.columns, F.explode(around("_at", dims, list(product((-1, 0, 1), repeat=dims)))).alias("_c"))
    near = near.select(*left.columns, *[c(f"_c.c{i}").alias(f"_p{i}") for i in range(dims)])
    for level, box in enumerate(boxes):
        # At the top a cell is looked up itself, below by its parent.
        box = box.withColumns({f"_p{i}": F.shiftright(k, 2) if level else c(k) for i, k in enumerate(keys)})
        seen = near.join(box, [f"_p{i}" for i in range(dims)])
        least, most = F.lit(0.0), F.lit(0.0)
        for a, lo, hi in zip(left_axes, low, high):
            gap, far = F.greatest(c(lo) - c(a), c(a) - c(hi), F.lit(0.0)), F.greatest(F.abs(c(a) - c(lo)), F.abs(c(a) - c(hi)))
            least, most = least + gap * gap, most + far * far
        seen = seen.select(*left.columns, *[c(k).alias(f"_p{i}") for i, k in enumerate(keys)], least.alias("_least"), most.alias("_most"))
        seen = cut_lineage(seen.filter(c("_least") <= radius * radius * (1 + 1e-9)))
        bound = seen.groupBy(c(own).alias("_own")).agg(F.min("_most").alias("_bound"))
        near = seen.join(bound, c(own) == c("_own")).filter(c("_least") <= c("_bound") * (1 + 1e-9) + 1e-18).select(*left.columns, *[f"_p{i}" for i in range(dims)])
    pairs = near.join(placed.withColumnsRenamed({k: f"_p{i}" for i, k in enumerate(keys)}), [f"_p{i}" for i in range(dims)])
    gap = None
    for p, q in zip(left_axes, right_axes):
        d = (c(p) - c(q)) * (c(p) - c(q))
        gap = d if gap is None else gap + d
    pairs = pairs.withColumn("_d", F.sqrt(gap)).filter(c("_d") < radius)
    return pairs.groupBy(own).agg(F.min(F.struct("_d", *order)).alias("m"))


def door_points(masks: DataFrame, keyframes: DataFrame, floor: DataFrame, mask_size: tuple[int, int], radius: float = 0.5) -> DataFrame:
    """Floor point nearest to the ray through each keyframe's door-mask centre.

    ``masks``: kf, u, v of set pixels. ``keyframes``: kf, r0..r8 (world to camera),
    camera position px, py, pz. The ray is sampled at 20 distances from 0.5 to 10 m.
    """
    from waymark.functions import geometry as g

    w, h = mask_size
    centre = masks.groupBy("kf").agg(F.avg("u").cast("long").alias("u"), F.avg("v").cast("long").alias("v"))
    ray = g.equirect_bearing(F.col("u"), F.col("v"), w, h)
    posed = centre.select("kf", *[v.alias(f"_b{i}") for i, v in enumerate(ray)]).join(keyframes, "kf")
    world = g.apply(g.transpose([F.col(f"r{i}") for i in range(9)]), [F.col(f"_b{i}") for i in range(3)])
    # 20 samples, 0.5 m apart, from 0.5 m.
    step = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("step")
    rays = posed.select("kf", "px", "py", "pz", *[v.alias(f"_w{i}") for i, v in enumerate(world)]).select("*", step)
    dist = F.col("step") * 0.5 + 0.5
    samples = rays.select(
        "kf", "step", *[(F.col(p) + F.col(f"_w{i}") * dist).alias(s) for i, (p, s) in enumerate((("px", "sx"), ("py", "sy"), ("pz", "sz")))]
    )
    spots = floor.select("x", "y", "z").distinct()
    best = nearest_of_all(samples, spots, "kf", ["sx", "sy", "sz"], ["x", "y", "z"], radius, ["step", "x", "y", "z"])
    return best.select("kf", "m.x", "m.y", "m.z", F.col("m._d").alias("dist"))
