"""Two-view verification by epipolar geometry.

The matches of an image pair stand in one row. Fundamental matrices through eight of them are solved in batches, all of a batch side by side in the last axis
of a few arrays; how many depends on the share of inliers seen so far and the wanted confidence. They are compared by squared
distances cut at the tolerance; a better one is fitted again to its inliers while that falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.vectors import each_pair, pack_matches
from waymark.session import parallelism

#: Hypotheses solved at once; hypotheses of a pair, at most (enough for 28 % inliers at 99 %).
BATCH, MOST = 512, 120_000
#: Places on and above the diagonal of a symmetric matrix.
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def normalizer(p: np.ndarray) -> np.ndarray:
    """The similarity that moves the points' centre to 0 and their mean distance from it to the square root of 2."""
    mid = p.mean(axis=0)
    size = np.sqrt(((p - mid) ** 2).sum(axis=1)).mean()
    s = np.sqrt(2) / size if size > 0 else 1.0
    return np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1.0]])


def rows_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The equation q' F p = 0 of each match in the nine entries of F; points are homogeneous."""
    return (q[..., :, None] * p[..., None, :]).reshape(*p.shape[:-1], 9)


def rank_two(f: np.ndarray) -> np.ndarray:
    u, s, v = np.linalg.svd(f)
    s[..., 2] = 0
    return u @ (s[..., :, None] * v)


def sampson(f: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared Sampson distance of each match (columns) under each matrix (rows)."""
    fp, fq = p @ np.swapaxes(f, 1, 2), q @ f
    e = (q[None] * fp).sum(axis=2)
    down = fp[..., 0] ** 2 + fp[..., 1] ** 2 + fq[..., 0] ** 2 + fq[..., 1] ** 2
    return e * e / np.maximum(down, 1e-300)


def smallest_eight(x: np.ndarray) -> np.ndarray:
    """The places of the eight smallest numbers (all in [0, 1)) of each row, in any order."""
    count, n = x.shape
    if not 64 <= n < 1 << 16:
        return x.argpartition(7, axis=1)[:, :8]
    # About sixteen of a row lie below a bound; row, value and place are sorted as one number.
    at = np.flatnonzero(x < 16 / n)
    row, place = np.divmod(at.astype(np.int32), np.int32(n))
    key = (row.astype(np.int64) << 52) | ((x.ravel()[at] * (1 << 36)).astype(np.int64) << 16) | place
    key.sort()
    found = np.bincount(row, minlength=count)
    first = np.minimum(np.cumsum(found) - found, max(0, len(key) - 8))
    few = np.flatnonzero(found < 8)
    out = key[first[:, None] + np.arange(8)] & 0xFFFF if len(key) >= 8 else np.zeros((count, 8), np.int64)
    out[few] = x[few].argpartition(7, axis=1)[:, :8]
    return out


def null_vectors(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (9, batch) that solve eight equations (9 entries, 8, batch) by reflections, and the volume the equations span; ``m`` is used up."""
    volume, kept = np.ones(m.shape[2]), []
    for k in range(8):
        v = m[k:, k].copy()
        size = np.sqrt((v * v).sum(axis=0))
        volume *= size
        v[0] += np.copysign(size, v[0])
        scale = (v * v).sum(axis=0)
        w = v * (2.0 / np.where(scale > 0, scale, 1.0))
        kept.append((v, w))
        rest = m[k:, k + 1 :]
        rest -= v[:, None] * (w[:, None] * rest).sum(axis=0)
    out = np.zeros((9, m.shape[2]))
    out[8] = 1.0
    for k in range(7, -1, -1):
        v, w = kept[k]
        out[k:] -= v * (w * out[k:]).sum(axis=0)
    return out, volume


def nearly_rank_two(f: np.ndarray) -> np.ndarray:
    """Matrices (9, batch) without their part along the smallest singular vector, which powers of the squared adjugate bring out."""
    a = f.reshape(3, 3, -1)
    c = [a[i - 2, j - 2] * a[i - 1, j - 1] - a[i - 2, j - 1] * a[i - 1, j - 2] for j in range(3) for i in range(3)]
    xx, xy, xz, yy, yz, zz = (c[3 * i] * c[3 * j] + c[3 * i + 1] * c[3 * j + 1] + c[3 * i + 2] * c[3 * j + 2] for i, j in PAIRS)
    for _ in range(6):
        size = xx + yy + zz
        size[size <= 0] = 1.0
        xx, xy, xz, yy, yz, zz = (v / size for v in (xx, xy, xz, yy, yz, zz))
        xx, xy, xz, yy, yz, zz = (
            xx * xx + xy * xy + xz * xz, xx * xy + xy * yy + xz * yz, xx * xz + xy * yz + xz * zz,
            xy * xy + yy * yy + yz * yz, xy * xz + yy * yz + yz * zz, xz * xz + yz * yz + zz * zz,
        )
    s = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
    v = s[np.stack([xx, yy, zz]).argmax(axis=0), :, np.arange(len(xx))].T
    size = np.sqrt((v * v).sum(axis=0))
    size[size <= 0] = 1.0
    v = v / size
    return (a - (a * v).sum(axis=1)[:, None] * v).reshape(9, -1)


def quadratic(v: np.ndarray) -> np.ndarray:
    """The products of homogeneous points (n, 3) that a squared length of linear forms is a sum of."""
    return np.stack([(1 if i == j else 2) * v[:, i] * v[:, j] for i, j in PAIRS])


def losses(f: np.ndarray, both: np.ndarray, squares: np.ndarray, most: float) -> np.ndarray:
    """Sum over all matches of the squared Sampson distance, cut at ``most``, under each matrix (9, batch).

    ``both`` (9, n) are the matches' ``rows_of``, ``squares`` (12, n) the ``quadratic`` products of their first and second points.
    """
    a = f.reshape(3, 3, -1)
    e = f.T @ both
    e *= e
    down = np.stack([a[0, i] * a[0, j] + a[1, i] * a[1, j] for i, j in PAIRS] + [a[i, 0] * a[j, 0] + a[i, 1] * a[j, 1] for i, j in PAIRS]).T @ squares
    e /= np.maximum(down, 1e-300, out=down)
    return np.minimum(e, most, out=e).sum(axis=1)


def eight_point(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least-squares matrix through eight or more matches, in pixels."""
    tp, tq = normalizer(p[:, :2]), normalizer(q[:, :2])
    f = np.linalg.svd(rows_of(p @ tp.T, q @ tq.T))[2][-1].reshape(3, 3)
    return tq.T @ rank_two(f) @ tp


def needed(inliers: int, n: int, confidence: float) -> float:
    """Samples of eight among which one holds inliers only, with that confidence."""
    clean = (inliers / n) ** 8
    return 0.0 if clean >= 1 else np.log(1 - confidence) / np.log1p(-clean) if clean > 0 else np.inf


def fit_two_view(p: np.ndarray, q: np.ndarray, tol: float, confidence: float = 0.99, most: int = MOST, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Matrix, inlier mask (Sampson distance up to ``tol`` pixels) and number of hypotheses; none with under eight matches."""
    n = len(p)
    if n < 8:
        return None
    p, q = (np.concatenate([v, np.ones((n, 1))], axis=1) for v in (p, q))
    if not (np.isfinite(p).all() and np.isfinite(q).all()):
        return None
    tp, tq = normalizer(p[:, :2]), normalizer(q[:, :2])
    a, both, squares = rows_of(p @ tp.T, q @ tq.T).T, rows_of(p, q).T.copy(), np.concatenate([quadratic(p), quadratic(q)])
    pixels = np.kron(tq.T, tp.T)  # takes a matrix, row by row, to pixels
    rng = np.random.default_rng(seed)
    best, mask, cost, tried, want = None, np.zeros(n, bool), np.inf, 0, float(most)
    while tried < min(want, most):
        pick = smallest_eight(rng.random((BATCH, n))) if n > 8 else np.arange(8)[None]
        f, volume = null_vectors(a[:, pick.T])
        # Samples of dependent equations are left out, by the determinant with one random equation besides.
        f = f[:, volume * np.abs((rng.standard_normal((len(pick), 9)).T * f).sum(axis=0)) > 1e-14]
        tried += len(pick)
        if f.shape[1]:
            loss = losses(pixels @ nearly_rank_two(f), both, squares, tol * tol)
            top = int(loss.argmin())
            if loss[top] < cost:
                first = tq.T @ rank_two(f[:, top].reshape(3, 3)) @ tp
                now = float(np.minimum(sampson(first[None], p, q), tol * tol).sum())
                if now < cost:
                    best, cost = refined(first, now, p, q, tol)
                    mask = sampson(best[None], p, q)[0] <= tol * tol
        if n == 8:
            break
        want = needed(int(mask.sum()), n, confidence)
    return (best, mask, tried) if best is not None else None


def refined(f: np.ndarray, cost: float, p: np.ndarray, q: np.ndarray, tol: float) -> tuple[np.ndarray, float]:
    """Fit again to the matches within three times the median distance of the inliers, as long as the truncated loss falls."""
    for _ in range(20):
        d = sampson(f[None], p, q)[0]
        inside = d <= tol * tol
        if inside.sum() < 8:
            break
        use = inside & (d <= max(9 * float(np.median(d[inside])), 1e-12))
        if use.sum() < 8:
            break
        again = eight_point(p[use], q[use])
        now = float(np.minimum(sampson(again[None], p, q)[0], tol * tol).sum())
        if now >= cost:
            break
        f, cost = again, now
    return f, cost


def two_view(matches: DataFrame, tol: float = 1.0, least: int = 20, confidence: float = 0.99, most: int = MOST) -> DataFrame:
    """Inlier matches of the epipolar geometry of each image pair: img1, img2, kp1, kp2, inliers, f (nine numbers).

    ``matches``: img1, img2, kp1, kp2, x1, y1, x2, y2, at most ``max_matches`` a pair. Pairs with fewer than ``least`` inliers drop out. Samples are drawn from a
    seed of the pair's ids, after its matches are put in order, so results do not depend on partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out, mats = [], [[], [], []], []
            ids = np.stack([b.column(k).to_numpy() for k in (0, 1)], axis=1)
            for r, (kp1, kp2, x1, y1, x2, y2) in each_pair(b):
                o = np.lexsort((kp2, kp1))
                found = fit_two_view(np.stack([x1, y1], 1)[o], np.stack([x2, y2], 1)[o], tol, confidence, most, [abs(int(v)) for v in ids[r]])
                if found is None or (n := int(found[1].sum())) < least:
                    continue
                row.append(np.full(n, r))
                at = o[found[1]]
                for c, v in zip(out, (kp1[at], kp2[at], np.full(n, n)), strict=True):
                    c.append(v)
                mats += [(found[0] / np.linalg.norm(found[0])).ravel().tolist()] * n
            row = np.concatenate(row) if row else np.zeros(0, np.int64)
            img = [b.column(k).take(pa.array(row)) for k in (0, 1)]
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([*img, *cols, pa.array(mats, pa.list_(pa.float64()))], names=["img1", "img2", "kp1", "kp2", "inliers", "f"])

    # The work of a pair outweighs its bytes: spread it evenly.
    packed = pack_matches(matches).repartition(parallelism(matches.sparkSession))
    return packed.mapInArrow(run, "img1 long, img2 long, kp1 long, kp2 long, inliers long, f array<double>")


def sampson_distance(f, x1, y1, x2, y2):
    """Sampson distance in pixels as a column: ``f`` is an array column of nine numbers, row by row."""
    a = [f[k] for k in range(9)]
    p = [a[3 * r] * x1 + a[3 * r + 1] * y1 + a[3 * r + 2] for r in range(3)]
    q = [a[c] * x2 + a[3 + c] * y2 + a[6 + c] for c in range(2)]
    e = x2 * p[0] + y2 * p[1] + p[2]
    return F.abs(e) / F.sqrt(p[0] * p[0] + p[1] * p[1] + q[0] * q[0] + q[1] * q[1])


def score_geometry(matches: DataFrame, geometry: DataFrame, tol: float = 1.0) -> DataFrame:
    """img1, img2, matches, inliers of given matrices (img1, img2, f) over the matches of each pair."""
    d = sampson_distance(F.col("f"), *[F.col(n) for n in ("x1", "y1", "x2", "y2")])
    rows = matches.join(geometry.select("img1", "img2", "f"), ["img1", "img2"])
    return rows.groupBy("img1", "img2").agg(F.count("*").alias("matches"), F.count_if(d <= tol).alias("inliers"))
