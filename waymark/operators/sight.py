"""Sight lines, snapping and nearest edges over a grid of each floor's edges.

A floor's outline is an annotation file's worth of edges. They are held in arrays with a grid over them, and rows of that floor
stream past in Arrow batches: a segment meets only the edges of the cells it runs through, a point only those of its row of cells, and a search for the
nearest edge widens ring by ring. Rows of one floor are dealt into blocks, so a floor with very many rows is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.polygons import DOOR, MAP_KEY, OBSTACLE, SHORT, STEP, WALKABLE
from waymark.session import parallelism

#: Cells along one side of a floor's grid, at most.
MOST_CELLS = 1024
#: Rows of a floor that one block holds; segments worked on at once.
BLOCK, CHUNK = 256, 1 << 15
#: Edges closer to a cell than this belong to it as well.
MARGIN = 1e-6
#: Edges of a floor up to which every segment and point is held against all of them, without the grid; entries of such a table at once.
FEW, TABLE = 64, 1 << 14
#: Rows of a batch that is sent on, at least.
SENT = 4096


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For item i repeated ``counts[i]`` times: the item and its running number."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def tally(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``key`` (all below ``size``) in order, and how often each stands there."""
    if size > 8 * len(key) + CHUNK:
        return np.unique(key, return_counts=True)
    n = np.bincount(key, minlength=1)
    found = np.flatnonzero(n)
    return found, n[found]


class Index:
    """Items by cell, as a sorted list with offsets."""

    def __init__(self, item: np.ndarray, cell: np.ndarray, cells: int):
        order = np.argsort(cell, kind="stable")
        self.item = item[order]
        self.start = np.searchsorted(cell[order], np.arange(cells + 1))

    def look(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``cell``, item) for all items in these cells."""
        row, k = spread(self.start[cell + 1] - self.start[cell])
        return row, self.item[self.start[cell][row] + k]


class Edges:
    """Segments with a grid over them."""

    def __init__(self, ax, ay, bx, by):
        self.ax, self.ay, self.bx, self.by = (np.asarray(v, float) for v in (ax, ay, bx, by))
        n = len(self.ax)
        xs, ys = np.concatenate([self.ax, self.bx]), np.concatenate([self.ay, self.by])
        self.x0, self.y0 = (xs.min(), ys.min()) if n else (0.0, 0.0)
        wide, high = (xs.max() - self.x0, ys.max() - self.y0) if n else (0.0, 0.0)
        self.size = max(wide, high, 1e-9) / min(MOST_CELLS, max(1, int(np.ceil(np.sqrt(n)))))
        self.nx, self.ny = int(wide / self.size) + 1, int(high / self.size) + 1

    @cached_property
    def index(self) -> Index:
        return Index(*self.cells(self.ax, self.ay, self.bx, self.by), self.nx * self.ny)

    def column(self, x):
        return np.clip(np.floor((x - self.x0) / self.size), 0, self.nx - 1).astype(np.int64)

    def line(self, y):
        return np.clip(np.floor((y - self.y0) / self.size), 0, self.ny - 1).astype(np.int64)

    def cells(self, px, py, qx, qy) -> tuple[np.ndarray, np.ndarray]:
        """(segment, cell) for every cell a segment runs through, column by column; parts beyond the grid count to its rim."""
        swap = qx < px
        lx, ly, rx, ry = np.where(swap, qx, px), np.where(swap, qy, py), np.where(swap, px, qx), np.where(swap, py, qy)
        c0, c1 = self.column(lx - MARGIN), self.column(rx + MARGIN)
        seg, k = spread(c1 - c0 + 1)
        col = c0[seg] + k
        left = np.where(k == 0, lx[seg], np.maximum(lx[seg], self.x0 + col * self.size - MARGIN))
        right = np.where(col == c1[seg], rx[seg], np.minimum(rx[seg], self.x0 + (col + 1) * self.size + MARGIN))
        run = (rx - lx)[seg]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(run > 0, (ry - ly)[seg] / run, 0.0)
            y0 = np.where(run > MARGIN, ly[seg] + (left - lx[seg]) * slope, ly[seg])
            y1 = np.where(run > MARGIN, ly[seg] + (right - lx[seg]) * slope, ry[seg])
        r0, r1 = self.line(np.minimum(y0, y1) - MARGIN), self.line(np.maximum(y0, y1) + MARGIN)
        part, j = spread(r1 - r0 + 1)
        return seg[part], col[part] * self.ny + r0[part] + j

    def near(self, px, py, qx, qy) -> tuple[np.ndarray, np.ndarray]:
        """(segment, edge) for edges that share a cell with the segment, each once."""
        seg, cell = self.cells(px, py, qx, qy)
        row, edge = self.index.look(cell)
        if not len(edge):
            return edge, edge
        key, _ = tally(seg[row] * len(self.ax) + edge, len(px) * len(self.ax))
        return key // len(self.ax), key % len(self.ax)

    def foot(self, x, y, edge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance and place of the point of ``edge`` nearest to (x, y)."""
        ax, ay = self.ax[edge], self.ay[edge]
        dx, dy = self.bx[edge] - ax, self.by[edge] - ay
        l2 = dx * dx + dy * dy
        t = np.where(l2 > 0, ((x - ax) * dx + (y - ay) * dy) / np.where(l2 > 0, l2, 1.0), 0.0)
        t = np.clip(t, 0.0, 1.0)
        nx, ny = ax + t * dx, ay + t * dy
        return np.sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), nx, ny

    def ring(self, x, y, ring: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, edge), each once, for the edges of the cells up to ``ring`` away; and how near to each point the other edges can be."""
        cx, cy = self.column(x), self.line(y)
        c0, c1, r0, r1 = cx - ring, cx + ring, cy - ring, cy + ring
        # Beyond the grid there is nothing.
        rim = np.minimum(
            np.minimum(np.where(c0 > 0, x - (self.x0 + c0 * self.size), np.inf), np.where(c1 < self.nx - 1, self.x0 + (c1 + 1) * self.size - x, np.inf)),
            np.minimum(np.where(r0 > 0, y - (self.y0 + r0 * self.size), np.inf), np.where(r1 < self.ny - 1, self.y0 + (r1 + 1) * self.size - y, np.inf)),
        )
        c0, c1, r0, r1 = np.maximum(c0, 0), np.minimum(c1, self.nx - 1), np.maximum(r0, 0), np.minimum(r1, self.ny - 1)
        a, k = spread(c1 - c0 + 1)
        b, j = spread((r1 - r0 + 1)[a])
        row, e = self.index.look((c0[a] + k)[b] * self.ny + r0[a][b] + j)
        key = np.unique(a[b][row] * max(1, len(self.ax)) + e)
        return key // max(1, len(self.ax)), key % max(1, len(self.ax)), rim - MARGIN

    def nearest(self, x, y, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(edge, distance, x, y) of the nearest point on any edge; ties by the place, or by ``rank`` of the edge.

        Rings of cells widen until the best hit is nearer than any edge outside can be. Without edges the edge is -1.
        """
        n = len(x)
        edge, d, fx, fy = np.full(n, -1), np.full(n, np.inf), np.full(n, np.nan), np.full(n, np.nan)
        todo = np.arange(n) if len(self.ax) else np.zeros(0, np.int64)
        ring = 1
        while len(todo):
            at, e, rim = self.ring(x[todo], y[todo], ring)
            p = todo[at]
            dd, xx, yy = self.foot(x[p], y[p], e)
            ties = (rank[e],) if rank is not None else (yy, xx)
            best = np.lexsort((*ties, dd, at))
            best = best[np.unique(at[best], return_index=True)[1]]
            p = p[best]
            edge[p], d[p], fx[p], fy[p] = e[best], dd[best], xx[best], yy[best]
            todo = todo[d[todo] >= rim]
            ring *= 2
        return edge, d, fx, fy


class Plan(Edges):
    """A floor's polygons: ``poly`` is each edge's polygon (in file order), ``group`` each polygon's group."""

    def __init__(self, ax, ay, bx, by, poly, group):
        super().__init__(ax, ay, bx, by)
        self.poly, self.group = np.asarray(poly, np.int64), np.asarray(group, np.int64)
        self._outline: Edges | None = None
        # The sloped edges of each polygon that counts for ``covered``, if the floor has few edges.
        self.rings: list[tuple[int, list[tuple[float, ...]]]] | None = None
        if len(self.ax) <= FEW:
            rows: dict[int, list[tuple[float, ...]]] = {}
            kinds = self.group.tolist()
            for k, *ends in zip(*(v.tolist() for v in (self.poly, self.ax, self.ay, self.bx, self.by)), strict=True):
                if ends[1] != ends[3] and kinds[k] in (WALKABLE, DOOR, OBSTACLE):
                    rows.setdefault(k, []).append(tuple(ends))
            self.rings = [(kinds[k], ends) for k, ends in rows.items()]

    @cached_property
    def strips(self) -> Index:
        """Sloped edges by the lines of cells they reach."""
        sloped = np.flatnonzero(self.ay != self.by)
        lo, hi = self.line(np.minimum(self.ay, self.by)[sloped]), self.line(np.maximum(self.ay, self.by)[sloped])
        e, k = spread(hi - lo + 1)
        return Index(sloped[e], lo[e] + k, self.ny)

    @classmethod
    def of(cls, polys: list[dict]) -> Plan:
        rows = [(e["ax"], e["ay"], e["bx"], e["by"], k) for k, p in enumerate(polys) for e in p["edges"]]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return cls(*cols, [p["group_id"] for p in polys])

    @classmethod
    def read(cls, polys: pa.StructArray) -> Plan:
        """``of`` for polygons in Arrow's form."""
        rings = polys.field("edges")
        ends = rings.flatten()
        poly = np.repeat(np.arange(len(polys)), pc.list_value_length(rings).fill_null(0).to_numpy(zero_copy_only=False))
        return cls(*(column(ends, n) for n in ("ax", "ay", "bx", "by")), poly, column(polys, "group_id"))

    def odd(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """(point, polygon) where a ray to the right crosses the polygon an odd number of times."""
        point, e = self.strips.look(self.line(y))
        px, py = x[point], y[point]
        hit = (self.ay[e] > py) != (self.by[e] > py)
        point, e, px, py = point[hit], e[hit], px[hit], py[hit]
        hit = px < (self.bx[e] - self.ax[e]) * (py - self.ay[e]) / (self.by[e] - self.ay[e]) + self.ax[e]
        key, n = tally(point[hit] * len(self.group) + self.poly[e[hit]], len(x) * len(self.group))
        key = key[n % 2 == 1]
        return key // max(1, len(self.group)), key % max(1, len(self.group))

    def covered(self, x, y) -> np.ndarray:
        """In a walkable or door polygon and in no obstacle."""
        if self.rings is not None:
            return self._covered(x, y)
        point, poly = self.odd(x, y)
        open_, blocked = np.zeros(len(x), bool), np.zeros(len(x), bool)
        kind = self.group[poly]
        open_[point[(kind == WALKABLE) | (kind == DOOR)]] = True
        blocked[point[kind == OBSTACLE]] = True
        return open_ & ~blocked

    def _covered(self, x, y) -> np.ndarray:
        open_, blocked = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for lo in range(0, len(x), TABLE):
            px, py = x[lo : lo + TABLE], y[lo : lo + TABLE]
            above = {}  # neighbouring edges share their ends
            for kind, ends in self.rings:
                odd = np.zeros(len(px), bool)
                for ax, ay, bx, by in ends:
                    for v in (ay, by):
                        if v not in above:
                            above[v] = v > py
                    hit = above[ay] != above[by]
                    hit &= px < (ax if ax == bx else (bx - ax) * (py - ay) / (by - ay) + ax)
                    odd ^= hit
                some = blocked if kind == OBSTACLE else open_
                some[lo : lo + TABLE] |= odd
        return open_ & ~blocked

    def contains(self, x, y) -> np.ndarray:
        """Strictly inside: all four diagonal side steps are covered."""
        dx, dy = np.array([[STEP, STEP, -STEP, -STEP], [STEP, -STEP, STEP, -STEP]])[:, :, None]
        return self.covered((x + dx).ravel(), (y + dy).ravel()).reshape(4, -1).all(axis=0)

    def cuts(self, px, py, qx, qy, seg, e) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, edge, t) for places strictly between the ends where a segment meets an edge of the pairs (seg, e), both ends of a common stretch."""
        dx, dy = (qx - px)[seg], (qy - py)[seg]
        ex, ey = self.bx[e] - self.ax[e], self.by[e] - self.ay[e]
        wx, wy = self.ax[e] - px[seg], self.ay[e] - py[seg]
        denom, off, length2 = dx * ey - dy * ex, wx * dy - wy * dx, dx * dx + dy * dy
        parallel = np.abs(denom) <= 1e-12
        safe = np.where(parallel, 1.0, denom)
        t, u = (wx * ey - wy * ex) / safe, off / safe
        cross = ~parallel & (u >= -1e-12) & (u <= 1 + 1e-12)
        l2 = np.where(length2 > 0, length2, 1.0)
        along = parallel & (np.abs(off) <= 1e-9) & (length2 > 0)
        a, b = (wx * dx + wy * dy) / l2, (wx * dx + wy * dy + ex * dx + ey * dy) / l2
        at = np.concatenate([np.flatnonzero(cross), np.flatnonzero(along), np.flatnonzero(along)])
        t = np.concatenate([t[cross], a[along], b[along]])
        keep = (t > 0) & (t < 1)
        return seg[at[keep]], e[at[keep]], t[keep]

    def meetings(self, px, py, qx, qy) -> tuple[np.ndarray, np.ndarray]:
        """(segment, t) of the ``cuts`` of each segment with all edges."""
        if self.rings is None:
            seg, e = self.near(px, py, qx, qy)
            seg, _, t = self.cuts(px, py, qx, qy, seg, e)
            return seg, t
        found = [(np.zeros(0, np.int64), np.zeros(0))]
        ax, ay = self.ax[:, None], self.ay[:, None]
        ex, ey = self.bx[:, None] - ax, self.by[:, None] - ay
        step = max(1, TABLE // max(1, len(ax)))
        for lo in range(0, len(px), step):
            s = slice(lo, lo + step)
            dx, dy = qx[s] - px[s], qy[s] - py[s]
            wx, wy = ax - px[s], ay - py[s]
            denom, off = dx * ey - dy * ex, wx * dy - wy * dx
            parallel = np.abs(denom) <= 1e-12
            safe = np.where(parallel, 1.0, denom)
            t = (wx * ey - wy * ex) / safe
            off_edge = off / safe
            e, seg = np.nonzero((t > 0) & (t < 1) & (off_edge >= -1e-12) & (off_edge <= 1 + 1e-12) & ~parallel)
            found.append((seg + lo, t[e, seg]))
            length2 = dx * dx + dy * dy
            e, seg = np.nonzero(parallel & (np.abs(off) <= 1e-9) & (length2 > 0))
            if len(e):
                wx, wy, ux, uy, l2 = wx[e, seg], wy[e, seg], dx[seg], dy[seg], length2[seg]
                ends = (wx * ux + wy * uy) / l2, (wx * ux + wy * uy + ex[e, 0] * ux + ey[e, 0] * uy) / l2
                found += [(seg[(t > 0) & (t < 1)] + lo, t[(t > 0) & (t < 1)]) for t in ends]
        seg, t = zip(*found, strict=True)
        return np.concatenate(seg), np.concatenate(t)

    @staticmethod
    def spans(key, t, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, from, to) of the stretches between neighbouring cuts of each key; ``whole`` keys also begin at 0 and end at 1."""
        key = np.concatenate([key, whole, whole])
        t = np.concatenate([t, np.zeros(len(whole)), np.ones(len(whole))])
        order = np.lexsort((t, key))
        key, t = key[order], t[order]
        same = (key[1:] == key[:-1]) & (t[1:] != t[:-1])
        return key[:-1][same], t[:-1][same], t[1:][same]

    def visible(self, px, py, qx, qy) -> np.ndarray:
        """Whether the walkable region contains each segment: every stretch between cuts has a covered side, some stretch both."""
        out = np.zeros(len(px), bool)
        for lo in range(0, len(px), CHUNK):
            s = slice(lo, lo + CHUNK)
            out[s] = self._visible(px[s], py[s], qx[s], qy[s])
        return out

    def _sides(self, px, py, qx, qy, seg, a, b, test) -> np.ndarray:
        """How many of the two sides of each stretch pass ``test``."""
        dx, dy = qx - px, qy - py
        length = np.sqrt(dx * dx + dy * dy)
        safe = np.where(length == 0, 1.0, length)
        nx, ny = np.where(length == 0, STEP, -dy / safe * STEP), dx / safe * STEP
        m = (a + b) / 2
        x, y = px[seg] + m * dx[seg], py[seg] + m * dy[seg]
        nx, ny = nx[seg], ny[seg]
        return test(np.concatenate([x + nx, x - nx]), np.concatenate([y + ny, y - ny])).reshape(2, -1).sum(axis=0)

    def _visible(self, px, py, qx, qy) -> np.ndarray:
        seg, t = self.meetings(px, py, qx, qy)
        # Stretches between cuts and ends; segment and place are sorted as one number, in which neighbours closer than any stretch that counts may be equal.
        key = np.concatenate([(seg << 46) + (t * (1 << 46)).astype(np.int64), np.arange(len(px)) << 46])
        key.sort()
        seg, a = key >> 46, (key & ((1 << 46) - 1)) / (1 << 46)
        b = np.append(a[1:], 1.0)
        b[np.append(seg[1:] != seg[:-1], True)] = 1.0
        length = np.sqrt((qx - px) ** 2 + (qy - py) ** 2)[seg]
        keep = ((b - a) * length > SHORT) | (length == 0)
        seg, a, b = seg[keep], a[keep], b[keep]
        sides = self._sides(px, py, qx, qy, seg, a, b, self.covered)
        none, both = np.zeros(len(px), bool), np.zeros(len(px), bool)
        none[seg[sides == 0]] = True
        both[seg[sides == 2]] = True
        return both & ~none

    def first_door(self, px, py, qx, qy) -> np.ndarray:
        """Distance along each segment of the centroid of the first door (in file order) it crosses; NaN without one."""
        out = np.full(len(px), np.nan)
        for lo in range(0, len(px), CHUNK):
            s = slice(lo, lo + CHUNK)
            out[s] = self._first_door(px[s], py[s], qx[s], qy[s])
        return out

    def _first_door(self, px, py, qx, qy) -> np.ndarray:
        n, size = len(px), max(1, len(self.group))
        out = np.full(n, np.nan)
        seg, e = self.near(px, py, qx, qy)
        door = (self.group[self.poly[e]] == DOOR) if len(e) else np.zeros(0, bool)
        seg, e = seg[door], e[door]
        length2 = (qx - px) ** 2 + (qy - py) ** 2
        keep = length2[seg] > 0
        seg, e = seg[keep], e[keep]
        whole = np.unique(seg * size + self.poly[e])
        cut, at, t = self.cuts(px, py, qx, qy, seg, e)
        key, a, b = self.spans(cut * size + self.poly[at], t, whole)
        seg, poly = key // size, key % size

        def within(x, y):
            point, p = self.odd(x, y)
            hit = np.zeros(len(x), bool)
            hit[point[p == poly[point % max(1, len(poly))]]] = True  # both sides of each stretch
            return hit

        sides = self._sides(px, py, qx, qy, seg, a, b, within)
        crossed = np.intersect1d(key[sides == 2], key[sides == 0])
        seg, first = np.unique(crossed // size, return_index=True)
        poly = (crossed % size)[first]
        dx, dy = (qx - px)[seg], (qy - py)[seg]
        cx, cy = self.centroids()
        along = ((cx[poly] - px[seg]) * dx + (cy[poly] - py[seg]) * dy) / length2[seg]
        out[seg] = np.clip(along, 0.0, 1.0) * np.sqrt(length2[seg])
        return out

    def centroids(self) -> tuple[np.ndarray, np.ndarray]:
        """Area centroid of each polygon by the shoelace sums."""
        w = self.ax * self.by - self.bx * self.ay
        sums = [np.bincount(self.poly, v, minlength=len(self.group)) for v in (w, (self.ax + self.bx) * w, (self.ay + self.by) * w)]
        with np.errstate(divide="ignore", invalid="ignore"):
            return sums[1] / (sums[0] * 3), sums[2] / (sums[0] * 3)

    def outline(self) -> Edges:
        """Pieces of edges between their cuts with exactly one covered side, each once."""
        if self._outline is None:
            seg, e = self.near(self.ax, self.ay, self.bx, self.by)
            seg, _, t = self.cuts(self.ax, self.ay, self.bx, self.by, seg, e)
            seg, a, b = self.spans(seg, t, np.arange(len(self.ax)))
            dx, dy = self.bx - self.ax, self.by - self.ay
            length = np.sqrt(dx * dx + dy * dy)
            keep = (length[seg] > 0) & ((b - a) * length[seg] > SHORT)
            seg, a, b = seg[keep], a[keep], b[keep]
            keep = self._sides(self.ax, self.ay, self.bx, self.by, seg, a, b, self.covered) == 1
            seg, a, b = seg[keep], a[keep], b[keep]
            ends = np.stack([self.ax[seg] + a * dx[seg], self.ay[seg] + a * dy[seg], self.ax[seg] + b * dx[seg], self.ay[seg] + b * dy[seg]], axis=1)
            self._outline = Edges(*np.unique(ends.reshape(-1, 4), axis=0).T)
        return self._outline

    def snap_inside(self, x, y, offset: float) -> tuple[np.ndarray, np.ndarray]:
        """The point itself when inside, else pushed ``offset`` inward from the nearest outline point."""
        sx, sy = x.copy(), y.copy()
        out = np.flatnonzero(~self.contains(x, y))
        edge, _, bx, by = self.outline().nearest(x[out], y[out])
        out, bx, by = out[edge >= 0], bx[edge >= 0], by[edge >= 0]
        dx, dy = x[out] - bx, y[out] - by
        size = np.sqrt(dx * dx + dy * dy)
        zero = size == 0  # on the outline itself the push goes along -x
        safe = np.where(zero, 1.0, size)
        ix, iy = bx - np.where(zero, 1.0, dx / safe) * offset, by - np.where(zero, 0.0, dy / safe) * offset
        ok = self.contains(ix, iy)
        sx[out], sy[out] = np.where(ok, ix, bx), np.where(ok, iy, by)
        return sx, sy

    def snap_toward(self, x, y, nav: Edges, offset: float) -> tuple[np.ndarray, np.ndarray]:
        """From an outside point toward the nearest waypoint whose ray meets the outline; without one, ``snap_inside``.

        ``nav`` holds the waypoints as edges without length. Rays are tried ring by ring, so most points try few of them.
        """
        sx, sy = x.copy(), y.copy()
        todo = np.flatnonzero(~self.contains(x, y)) if len(nav.ax) else np.zeros(0, np.int64)
        lost = np.flatnonzero(~self.contains(x, y)) if not len(nav.ax) else todo[:0]
        line, ring, tried = self.outline(), 1, np.zeros(len(x))
        while len(todo):
            at, w, rim = nav.ring(x[todo], y[todo], ring)
            d = np.sqrt((nav.ax[w] - x[todo[at]]) ** 2 + (nav.ay[w] - y[todo[at]]) ** 2)
            keep = (d >= tried[todo[at]]) & (d < rim[at])  # nearer ones had no ray; the next ring may hold one before farther ones
            at, w, d = at[keep], w[keep], d[keep]
            p = todo[at]
            t = self._first_meeting(line, x[p], y[p], nav.ax[w], nav.ay[w])
            hit = np.isfinite(t)
            at, w, t, d = at[hit], w[hit], t[hit], d[hit]
            best = np.lexsort((nav.ay[w], nav.ax[w], t, d, at))
            best = best[np.unique(at[best], return_index=True)[1]]
            p, w, t = todo[at[best]], w[best], t[best]
            ex, ey = x[p] + t * (nav.ax[w] - x[p]), y[p] + t * (nav.ay[w] - y[p])
            dx, dy = nav.ax[w] - ex, nav.ay[w] - ey
            size = np.sqrt(dx * dx + dy * dy)
            safe = np.where(size < 1e-6, 1.0, size)
            gx, gy = ex + dx / safe * offset, ey + dy / safe * offset
            ok = (size >= 1e-6) & self.contains(gx, gy)
            sx[p], sy[p] = np.where(ok, gx, ex), np.where(ok, gy, ey)
            tried[todo] = rim
            left = np.ones(len(todo), bool)
            left[at[best]] = False
            lost = np.concatenate([lost, todo[left & np.isinf(rim)]])
            todo = todo[left & np.isfinite(rim)]
            ring *= 2
        if len(lost):
            sx[lost], sy[lost] = self.snap_inside(x[lost], y[lost], offset)
        return sx, sy

    def _first_meeting(self, line: Edges, px, py, qx, qy) -> np.ndarray:
        """Smallest t in [0, 1] where each segment crosses ``line``; infinite without a crossing."""
        out = np.full(len(px), np.inf)
        for lo in range(0, len(px), CHUNK):
            s = slice(lo, lo + CHUNK)
            ax, ay = px[s], py[s]
            seg, e = line.near(ax, ay, qx[s], qy[s])
            dx, dy = (qx[s] - ax)[seg], (qy[s] - ay)[seg]
            ex, ey = line.bx[e] - line.ax[e], line.by[e] - line.ay[e]
            wx, wy = line.ax[e] - ax[seg], line.ay[e] - ay[seg]
            denom = dx * ey - dy * ex
            flat = np.abs(denom) <= 1e-12
            safe = np.where(flat, 1.0, denom)
            t, u = (wx * ey - wy * ex) / safe, (wx * dy - wy * dx) / safe
            ok = ~flat & (t >= 0) & (t <= 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
            np.minimum.at(out, lo + seg[ok], t[ok])
        return out


def by_floor(
    held: dict[str, DataFrame], streamed: DataFrame, deal: str, on_held: bool, work: Callable, schema: str, size: int = BLOCK,
    piece: int | None = None, key: list[str] = MAP_KEY,
) -> DataFrame:
    """Run ``work(held, rows) -> columns`` on the rows of each floor, a batch at a time, and put the floor's key before its columns.

    ``key`` may name other columns than the map key, of rows that belong together.

    ``held`` rows of a floor are kept in arrays, ``streamed`` rows pass by; all have the map key. The rows of one of them, the last of
    ``held`` if ``on_held`` else ``streamed``, are dealt into blocks of about ``size`` by column ``deal``; the others are copied to each block.
    ``held`` arrives as a dict of record batches' struct arrays (concatenated), ``rows`` as a struct array of at most ``piece`` rows.
    """
    names = [*held, "streamed"]
    frames = {**held, "streamed": streamed}
    big = names[-2] if on_held else "streamed"
    counts = frames[big].groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias("_nb"))
    types = {n: F.struct(*[c for c in frames[n].columns if c not in key]) for n in names}
    kinds = {n: frames[n].drop(*key).schema for n in names}
    parts = None
    for k, n in enumerate(names):
        rows = frames[n].join(counts, key)
        block = F.pmod(F.xxhash64(deal), F.col("_nb")).cast("int") if n == big else F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
        cells = [(types[m] if m == n else F.lit(None).cast(kinds[m])).alias(f"_{m}") for m in names]
        rows = rows.select(*key, block.alias("_block"), F.lit(k).alias("_kind"), *cells)
        parts = rows if parts is None else parts.unionByName(rows)
    group, width = [*key, "_block"], len(key)
    spread_rows = parts.repartition(parallelism(streamed.sparkSession), *group).sortWithinPartitions(*group, "_kind")
    columns = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        # Floors are small and a batch is costly to send, so those of many floors go out together.
        waiting, rows = [], 0
        for made in each(batches):
            waiting.append(made)
            rows += made.num_rows
            if rows >= SENT:
                yield pa.concat_batches(waiting)
                waiting, rows = [], 0
        if waiting:
            yield pa.concat_batches(waiting)

    def each(batches):
        at, kept, ready = None, {}, None
        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in range(width + 2):
                col = b.column(c)
                change[1:] |= pc.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
            change[0] = True
            starts = np.append(np.flatnonzero(change), b.num_rows)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                now = tuple(b.column(c)[lo].as_py() for c in range(width + 1))
                kind = b.column(width + 1)[lo].as_py()
                if now != at:
                    at, kept, ready = now, {}, None
                part = b.column(width + 2 + kind).slice(lo, hi - lo)
                if kind < len(names) - 1:
                    kept.setdefault(names[kind], []).append(part)
                    continue
                if ready is None:
                    ready = {n: pa.concat_arrays(v) for n, v in kept.items()}
                step = piece or len(part)
                for i in range(0, len(part), step):
                    made = work(ready, part.slice(i, step))
                    if made is not None and len(made[0]):
                        whose = [pa.repeat(pa.scalar(v), len(made[0])) for v in at[:width]]
                        yield pa.RecordBatch.from_arrays([*whose, *(c if isinstance(c, pa.Array) else pa.array(c) for c in made)], names=[*key, *columns])

    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streamed.select(*key).schema.fields)
    return spread_rows.mapInArrow(run, f"{keyed}, {schema}")


def column(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def plan_of(held: dict) -> Plan | None:
    """The floor's plan, made once for each block."""
    if "plan" not in held:
        held["plan"] = Plan.read(held["floor"].field("polys")[0].values) if "floor" in held else None
    return held["plan"]


def seen_pairs(
    left: DataFrame, right: DataFrame, floors: DataFrame, left_id: str, right_id: str, later: bool = False, hidden: bool = False
) -> DataFrame:
    """(map key, a, b, weight) for rows of one floor that see each other, ``weight`` their distance in pixels.

    ``left`` and ``right`` have the map key, x, y and their id (a long); ``floors`` map key and polys. With ``later``, ``right`` has a boolean
    ``any`` and a pair counts if that holds or the right id is the larger one. Only visible pairs are sent on; with ``hidden`` all that
    count are, with a column ``visible``.
    """

    def work(held, rows):
        plan = plan_of(held)
        if plan is None or "left" not in held:
            return None
        ax, ay, a = (column(held["left"], n) for n in ("x", "y", "id"))
        bx, by, b = (column(rows, n) for n in ("x", "y", "id"))
        i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
        if later:
            keep = column(rows, "any").astype(bool)[j] | (a[i] < b[j])
            i, j = i[keep], j[keep]
        see = plan.visible(ax[i], ay[i], bx[j], by[j])
        if not hidden:
            i, j = i[see], j[see]
        dx, dy = ax[i] - bx[j], ay[i] - by[j]
        return [a[i], b[j], np.sqrt(dx * dx + dy * dy), *([see] if hidden else [])]

    ends = [*MAP_KEY, "x", "y"]
    own = left.select(*ends, F.col(left_id).cast("long").alias("id"))
    other = right.select(*ends, F.col(right_id).cast("long").alias("id"), *(["any"] if later else []))
    schema = "a long, b long, weight double" + (", visible boolean" if hidden else "")
    return by_floor({"floor": floors.select(*MAP_KEY, "polys"), "left": own}, other, "id", True, work, schema, piece=CHUNK // BLOCK)


def crossed_doors(left: DataFrame, right: DataFrame, floors: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(map key, a, b, door_px) for all pairs that count as in ``seen_pairs`` with ``later``; null where the straight line crosses no door."""

    def work(held, rows):
        plan = plan_of(held)
        if plan is None or "left" not in held:
            return None
        ax, ay, a = (column(held["left"], n) for n in ("x", "y", "id"))
        bx, by, b = (column(rows, n) for n in ("x", "y", "id"))
        i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
        keep = column(rows, "any").astype(bool)[j] | (a[i] < b[j])
        i, j = i[keep], j[keep]
        return [a[i], b[j], plan.first_door(ax[i], ay[i], bx[j], by[j])]

    ends = [*MAP_KEY, "x", "y"]
    own = left.select(*ends, F.col(left_id).cast("long").alias("id"))
    other = right.select(*ends, F.col(right_id).cast("long").alias("id"), "any")
    held = {"floor": floors.select(*MAP_KEY, "polys"), "left": own}
    out = by_floor(held, other, "id", True, work, "a long, b long, door_px double", piece=CHUNK // BLOCK)
    return out.withColumn("door_px", F.nanvl("door_px", F.lit(None)))


def first_doors(rows: DataFrame, floors: DataFrame, seg: tuple[str, str, str, str], deal: str, name: str = "door_px") -> DataFrame:
    """``rows`` (map key and any columns) with the distance along each segment of the first door it crosses on its floor (map key, polys).

    Null where no door is crossed, a coordinate is missing, or the floor is unknown or has no polygons; no row is lost. Rows are dealt by column ``deal``.
    """
    own = [n for n in rows.columns if n not in MAP_KEY]
    known = F.lit(True)
    for n in MAP_KEY:
        known &= F.col(n).isNotNull()

    def work(held, part):
        plan, far = plan_of(held), np.full(len(part), np.nan)
        ends = [column(part, n).astype(float) for n in seg]
        at = np.flatnonzero(np.isfinite(ends).all(axis=0)) if plan is not None else []
        if len(at):
            far[at] = plan.first_door(*(e[at] for e in ends))
        return [*(part.field(n) for n in own), pa.array(far, mask=np.isnan(far))]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    near = by_floor({"floor": floors.select(*MAP_KEY, "polys")}, rows.filter(known), deal, False, work, f"{schema}, {name} double", 4096)
    return near.select(*rows.columns, name).unionByName(rows.filter(~known).withColumn(name, F.lit(None).cast("double")))


def snapped(points: DataFrame, floors: DataFrame, waypoints: DataFrame | None = None, offset: float = 5.0, point_id: str = "point_id") -> DataFrame:
    """(map key, id, sx, sy): ``points`` (id, map key, x, y) moved into the walkable region, toward ``waypoints`` (map key, x, y) if given.

    Points on floors without polygons stay out of the result.
    """

    def work(held, rows):
        plan = plan_of(held)
        if plan is None:
            return None
        x, y = column(rows, "x").astype(float), column(rows, "y").astype(float)
        if "nav" in held:
            if "way" not in held:
                nx, ny = column(held["nav"], "x"), column(held["nav"], "y")
                held["way"] = Edges(nx, ny, nx, ny)
            sx, sy = plan.snap_toward(x, y, held["way"], offset)
        else:
            sx, sy = plan.snap_inside(x, y, offset)
        return [column(rows, "id"), sx, sy]

    held = {"floor": floors.select(*MAP_KEY, "polys")}
    if waypoints is not None:
        held["nav"] = waypoints.select(*MAP_KEY, "x", "y")
    rows = points.select(*MAP_KEY, "x", "y", F.col(point_id).cast("long").alias("id"))
    return by_floor(held, rows, "id", False, work, "id long, sx double, sy double", 4096).withColumnRenamed("id", point_id)


def nearest_edges(points: DataFrame, edges: DataFrame, point_id: str = "point_id") -> DataFrame:
    """(map key, id, edge_id, dist, nx, ny): the point on the floor's edges (edge_id, ax, ay, bx, by) nearest to each point; ties to the smallest edge.

    Points on floors without edges stay out of the result.
    """

    def work(held, rows):
        if "edges" not in held:
            return None
        if "grid" not in held:
            e = held["edges"]
            held["grid"] = Edges(*(column(e, n) for n in ("ax", "ay", "bx", "by")))
            held["ids"] = column(e, "edge_id")
        grid, ids = held["grid"], held["ids"]
        x, y = column(rows, "x").astype(float), column(rows, "y").astype(float)
        edge, d, nx, ny = grid.nearest(x, y, rank=ids)
        keep = edge >= 0
        return [column(rows, "id")[keep], ids[edge[keep]], d[keep], nx[keep], ny[keep]]

    rows = points.select(*MAP_KEY, "x", "y", F.col(point_id).cast("long").alias("id"))
    own = edges.select(*MAP_KEY, F.col("edge_id").cast("long").alias("edge_id"), *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    out = by_floor({"edges": own}, rows, "id", False, work, "id long, edge_id long, dist double, nx double, ny double", 4096)
    return out.withColumnRenamed("id", point_id)
