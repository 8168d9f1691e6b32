"""Work on the rings of a whole Arrow batch at once.

The columns of ``geometry`` are folds over one ring's vertices and suit a few measures a row. Tests of many cells or angles
against each ring are done here instead: the vertices of a batch lie side by side, and a step runs over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of a point or line and an edge that are held at once.
PAIRS = 1 << 18
EPS = 1e-9


class Rings:
    """Edges of some rings side by side: ``first[i]`` to ``first[i + 1]`` are those of ring i, the last one back to its start."""

    def __init__(self, n: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.n, self.x, self.y = n, x, y
        self.first = np.r_[0, np.cumsum(n)]
        after = np.arange(1, len(x) + 1)
        some = n > 0
        after[self.first[1:][some] - 1] = self.first[:-1][some]
        self.bx, self.by = x[after], y[after]

    @classmethod
    def of(cls, rings: pa.Array) -> Rings:
        """An array of lists of (x, y); a missing ring has no vertex, a missing coordinate is NaN."""
        n = lengths(rings)
        points = rings.flatten()
        x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
        return cls(n, x, y)

    def extent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and largest x, least and largest y; NaN without a vertex."""
        return tuple(over(f, v, self.n) for v in (self.x, self.y) for f in (np.fmin, np.fmax))

    def edges_of(self, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked ring its edges: place of the asker, place of the edge."""
        many = self.n[ring]
        at = np.repeat(np.arange(len(ring)), many)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[ring], many)


def lengths(lists: pa.Array) -> np.ndarray:
    """Entries of each list; none where it is missing."""
    n = lists.value_lengths()
    return n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def over(f: np.ufunc, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``f`` over each of the groups of ``n`` values that lie side by side; NaN for empty ones."""
    out = np.full(len(n), np.nan)
    some = n > 0
    if some.any():
        out[some] = f.reduceat(values, (np.cumsum(n) - n)[some])
    return out


def in_steps(load: np.ndarray) -> Iterator[slice]:
    """Slices of rows, each of at most PAIRS in all or of one row."""
    far = np.cumsum(load)
    at = 0
    while at < len(load):
        to = max(at + 1, int(np.searchsorted(far, (far[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, to)
        at = to


def _any(flag: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at[flag], minlength=n) > 0


# --- points and boxes ---------------------------------------------------------


def _covers(r: Rings, ring: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Is each point inside its ring (even-odd) or on its boundary?"""
    ax, ay, bx, by, px, py = r.x[e], r.y[e], r.bx[e], r.by[e], x[at], y[at]
    dx, dy = bx - ax, by - ay
    spans = (ay > py) != (by > py)
    crossed = spans & (px < dx * np.where(dy != 0, (py - ay) / np.where(dy != 0, dy, 1.0), 0.0) + ax)
    inside = np.bincount(at[crossed], minlength=len(ring)) % 2 == 1
    along = (px >= np.minimum(ax, bx) - EPS) & (px <= np.maximum(ax, bx) + EPS) & (py >= np.minimum(ay, by) - EPS) & (py <= np.maximum(ay, by) + EPS)
    close = np.flatnonzero(along)
    if len(close):
        side = np.abs(dx[close] * (py - ay)[close] - dy[close] * (px - ax)[close])
        on = side <= EPS * np.maximum(np.hypot(dx[close], dy[close]), 1.0)
        inside |= np.bincount(at[close[on]], minlength=len(ring)) > 0
    return inside


def _cuts_box(r: Rings, x: np.ndarray, y: np.ndarray, dx: float, dy: float, at: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Does an edge enter the open box around each point? Edges are clipped to the box (Liang-Barsky)."""
    lo, hi, dead = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at), bool)
    for a, b, p, half in ((r.x, r.bx, x, dx / 2), (r.y, r.by, y, dy / 2)):
        start, d = a[e], b[e] - a[e]
        low, high = (p - half)[at] - start, (p + half)[at] - start
        moves = d != 0
        step = np.where(moves, d, 1.0)
        t0, t1 = low / step, high / step
        lo = np.where(moves, np.maximum(lo, np.minimum(t0, t1)), lo)
        hi = np.where(moves, np.minimum(hi, np.maximum(t0, t1)), hi)
        dead |= (np.abs(d) < 1e-15) & ((low >= 0) | (high <= 0))
    return _any(~dead & (hi - lo > 1e-12), at, len(x))


def cells_inside(rings: pa.Array, cells: pa.Array, dx: float, dy: float) -> pa.Array:
    """For each row's cells (structs that begin with x, y): is the cell wholly covered by the row's ring, or, where none of the
    row's cells is, its centre?"""
    r, many = Rings.of(rings), lengths(cells)
    points = cells.flatten()
    x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
    row = np.repeat(np.arange(len(many)), many)
    x0, x1, y0, y1 = r.extent()
    near = np.flatnonzero((x >= x0[row]) & (x <= x1[row]) & (y >= y0[row]) & (y <= y1[row]))
    full, centre = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for part in in_steps(r.n[row[near]]):
        these = near[part]
        ring, px, py = row[these], x[these], y[these]
        at, e = r.edges_of(ring)
        centre[these] = _covers(r, ring, px, py, at, e)
        # a covered box has its centre inside
        some = np.flatnonzero(centre[these])
        ring, px, py = ring[some], px[some], py[some]
        at, e = r.edges_of(ring)
        whole = ~_cuts_box(r, px, py, dx, dy, at, e)
        for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
            whole &= _covers(r, ring, px + i * dx / 2, py + j * dy / 2, at, e)
        full[these[some]] = whole
    any_full = np.bincount(row[full], minlength=len(many)) > 0
    inside = np.where(any_full[row], full, centre)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(inside))


def inside_column(ring: Column, cells: Column, dx: float, dy: float) -> Column:
    """:func:`cells_inside` as a column, an array of booleans in the order of ``cells``."""

    @F.arrow_udf("array<boolean>")
    def inside(r: pa.Array, c: pa.Array) -> pa.Array:
        return cells_inside(r, c, dx, dy)

    return inside(ring, cells)


# --- hulls --------------------------------------------------------------------


def support(rings: pa.Array, n_ring: int, n_theta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length around, area, and (rings, angles) support radii of the centred ``n_ring`` points at equal steps along the open path; NaN for
    fewer than three vertices."""
    r = Rings.of(rings)
    rows = len(r.n)
    ok = r.n >= 3
    ring = np.repeat(np.arange(rows), r.n)
    size = np.hypot(r.bx - r.x, r.by - r.y)
    around = np.where(ok, np.bincount(ring, size, rows), np.nan)
    start = np.minimum(r.first[:-1], max(len(r.x) - 1, 0))
    mx, my = (v - v[start][ring] if len(v) else v for v in (r.x, r.y))
    nx, ny = (v - w[start][ring] if len(v) else v for v, w in ((r.bx, r.x), (r.by, r.y)))
    area = np.where(ok, np.abs(np.bincount(ring, mx * ny - nx * my, rows) / 2), np.nan)
    walked = size.copy()
    last = r.first[1:][r.n > 0] - 1
    walked[last] = 0.0  # the path does not return to its start
    radii = np.full((rows, n_theta), np.nan)
    turns = [2 * math.pi * k / n_theta for k in range(n_theta)]
    good = np.flatnonzero(ok & (around > 0))
    for part in in_steps((r.n * n_ring)[good]):
        g = good[part]
        at, e = r.edges_of(g)
        many = r.n[g]
        begin = np.cumsum(many) - many
        place = np.arange(len(e)) - begin[at]
        steps = np.zeros((len(g), int(many.max())))
        steps[at, place] = walked[e]
        far = np.cumsum(steps, axis=1)
        total, behind = far[:, -1], np.where(steps > 0, np.c_[np.zeros(len(g)), far[:, :-1]], np.inf)  # edges without length are never the one a point lies on
        px, py = np.empty((len(g), n_ring)), np.empty((len(g), n_ring))
        for k in range(n_ring):
            d = total * k / float(n_ring)
            passed = behind <= (d + 1e-12)[:, None]
            seg = steps.shape[1] - 1 - np.argmax(passed[:, ::-1], axis=1)
            edge = e[begin + seg]
            f = (d - behind[np.arange(len(g)), seg]) / walked[edge]
            px[:, k] = r.x[edge] + (r.bx[edge] - r.x[edge]) * f
            py[:, k] = r.y[edge] + (r.by[edge] - r.y[edge]) * f
        px, py = (v - np.add.accumulate(v, axis=1)[:, -1:] / n_ring for v in (px, py))
        for k, t in enumerate(turns):
            radii[g, k] = (px * math.cos(t) + py * math.sin(t)).max(axis=1)
    return around, area, radii


def hull_column(ring: Column, n_ring: int, n_theta: int) -> Column:
    """Struct of perimeter, area and radii of a ring, computed once a row (so no step folds it into others)."""

    @F.arrow_udf("struct<perimeter:double,area:double,radii:array<double>>")
    def measured(rings: pa.Array) -> pa.Array:
        around, area, radii = support(rings, n_ring, n_theta)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(area) + 1) * n_theta, pa.int32()), pa.array(radii.ravel()))
        return pa.StructArray.from_arrays([pa.array(around, from_pandas=True), pa.array(area, from_pandas=True), lists], names=["perimeter", "area", "radii"])

    return measured.asNondeterministic()(ring)


def band_surface(below: np.ndarray, above: np.ndarray, dz: np.ndarray) -> np.ndarray:
    """Area of the two triangles of each quad between two layers of radii (rows by angles), in the km and days of their vertices."""
    n = below.shape[1]
    t = np.arange(n) * (2 * np.pi / n)
    at = lambda r: (r / 1000 * np.cos(t), r / 1000 * np.sin(t))
    (x1, y1), (x4, y4) = at(below), at(above)
    x2, y2, x3, y3 = (np.roll(v, -1, axis=1) for v in (x1, y1, x4, y4))
    x2, y2, x3, y3, x4, y4 = x2 - x1, y2 - y1, x3 - x1, y3 - y1, x4 - x1, y4 - y1
    dz = dz[:, None]
    half = lambda a, b, c: 0.5 * np.sqrt(a**2 + b**2 + c**2)
    return (half(y2 * dz, x2 * dz, x2 * y3 - y2 * x3) + half((y3 - y4) * dz, (x3 - x4) * dz, x3 * y4 - y3 * x4)).sum(axis=1)


def surface_column(below: Column, above: Column, dz: Column) -> Column:
    """:func:`band_surface` as a column; 0 where there is no layer above."""

    @F.arrow_udf("double")
    def surface(a: pa.Array, b: pa.Array, z: pa.Array) -> pa.Array:
        n, m = lengths(a), lengths(b)
        u, v = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (a, b))
        step, out = z.to_numpy(zero_copy_only=False).astype(float), np.zeros(len(n))
        first, second = np.cumsum(n) - n, np.cumsum(m) - m
        both = (n == m) & (n > 0)
        for k in np.unique(n[both]):
            g = np.flatnonzero(both & (n == k))
            out[g] = band_surface(u[first[g][:, None] + np.arange(k)], v[second[g][:, None] + np.arange(k)], step[g])
        return pa.array(out)

    return surface(below, above, dz)


# --- scanlines ----------------------------------------------------------------


def _index(v: np.ndarray, o: float, s: float) -> np.ndarray:
    return np.round((v - o) / s, 9)


def _middle_points(r: Rings, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A point inside each ring: middle of the widest span of a scanline near mid-height."""
    at, e = r.edges_of(ring)
    n = r.n[ring]
    x0, x1, y0, y1 = (over(f, v[e], n) for v in (r.x, r.y) for f in (np.fmin, np.fmax))
    mid = (y0 + y1) / 2
    low = r.y[e] <= mid[at]
    below = np.fmax(over(np.fmax, np.where(low, r.y[e], np.nan), n), -np.inf)
    above = np.fmin(over(np.fmin, np.where(low, np.nan, r.y[e]), n), np.inf)
    y = (np.where(np.isfinite(below), below, y0) + np.where(np.isfinite(above), above, y1)) / 2
    line, left, right = _spans(r, y, at, e)
    x = (x0 + x1) / 2
    order = np.lexsort(((left + right) / 2, right - left, line))
    x[line[order]] = ((right + left) / 2)[order]  # the widest span of a line comes last
    return x, y


def _spans(r: Rings, y: np.ndarray, at: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where horizontal lines run inside their rings: line, left and right end; sorted crossings taken two by two."""
    ay, by = r.y[e], r.by[e]
    cut = np.flatnonzero((ay > y[at]) != (by > y[at]))
    line, e = at[cut], e[cut]
    x = r.x[e] + (y[line] - r.y[e]) * (r.bx[e] - r.x[e]) / (r.by[e] - r.y[e])
    order = np.lexsort((x, line))
    line, x = line[order], x[order]
    many = np.bincount(line, minlength=len(y))
    place = np.arange(len(line)) - (np.cumsum(many) - many)[line]
    left = np.flatnonzero((place % 2 == 0) & (place + 1 < many[line]))
    return line[left], x[left], x[left + 1]


def grid_spans(rings: pa.Array, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int) -> pa.Array:
    """Per ring the cells of a grid whose centres lie strictly inside, as (iy, i0, i1, how); a ring without any has the cell nearest to its
    middle point (how 1), or no cell if its padded box misses the grid (how 2)."""
    r = Rings.of(rings)
    rows = len(r.n)
    bx0, bx1, by0, by1 = r.extent()
    with np.errstate(invalid="ignore"):
        lox, loy = np.maximum(np.ceil(_index(bx0 - dx, x0, dx)), 0), np.maximum(np.ceil(_index(by0 - dy, y0, dy)), 0)
        hix, hiy = np.minimum(np.floor(_index(bx1 + dx, x0, dx)), nx - 1), np.minimum(np.floor(_index(by1 + dy, y0, dy)), ny - 1)
        on_grid = (lox <= hix) & (loy <= hiy)
    places = np.flatnonzero(on_grid)
    lines = (hiy - loy + 1)[places].astype(np.int64)
    ring = np.repeat(places, lines)
    iy = np.arange(len(ring)) - np.repeat(np.cumsum(lines) - lines, lines) + np.repeat(loy[places].astype(np.int64), lines)
    found = []
    for part in in_steps(r.n[ring]):
        rr, line_y = ring[part], iy[part] * dy + y0
        at, e = r.edges_of(rr)
        line, left, right = _spans(r, line_y, at, e)
        i0 = np.maximum(np.ceil(_index(left, x0, dx)), lox[rr[line]]).astype(np.int64)
        i1 = np.minimum(np.floor(_index(right, x0, dx)), hix[rr[line]]).astype(np.int64)
        i0 += ~(i0 * dx + x0 > left + EPS)  # strictly inside: only the outermost cells can lie on the end
        i1 -= ~(i1 * dx + x0 < right - EPS)
        level = np.flatnonzero(np.abs(r.y[e] - line_y[at]) <= EPS)
        if len(level):  # lines that run along the ring, or touch it: cells on the ring are left out, one by one
            flat = np.abs(r.by[e[level]] - line_y[at[level]]) <= EPS
            a, b = r.x[e[level]], np.where(flat, r.bx[e[level]], r.x[e[level]])
            keep = np.bincount(at[level], minlength=len(rr))[line] == 0
            slow = np.flatnonzero(~keep & (i0 <= i1))
            many = (i1 - i0 + 1)[slow]
            own = np.repeat(slow, many)
            cell = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(i0[slow], many)
            order = np.argsort(at[level], kind="stable")
            where, a, b = at[level][order], np.minimum(a, b)[order], np.maximum(a, b)[order]
            from_, to = np.searchsorted(where, line[own]), np.searchsorted(where, line[own], "right")
            hit, far = np.zeros(len(own), bool), cell * dx + x0
            for k in range(int((to - from_).max(initial=0))):
                t = np.minimum(from_ + k, len(a) - 1)
                hit |= (from_ + k < to) & (far >= a[t] - EPS) & (far <= b[t] + EPS)
            own, cell = own[~hit], cell[~hit]
            line, i0, i1 = np.r_[line[keep], line[own]], np.r_[i0[keep], cell], np.r_[i1[keep], cell]
        some = i0 <= i1
        found.append((rr[line[some]], iy[part][line[some]], i0[some], i1[some]))
    who, cy, i0, i1 = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(4))
    how = np.zeros(len(who), np.int64)
    rest = np.flatnonzero(on_grid & (np.bincount(who, minlength=rows) == 0))
    px, py = _middle_points(r, rest)
    near = lambda v, o, s, n: np.clip(np.ceil(_index(v, o, s) - 0.5), 0, n - 1).astype(np.int64)
    off = np.flatnonzero(~on_grid)
    nx_, ny_, none = near(px, x0, dx, nx), near(py, y0, dy, ny), np.full(len(off), -1)
    who, cy, i0, i1 = np.r_[who, rest, off], np.r_[cy, ny_, none], np.r_[i0, nx_, none], np.r_[i1, nx_, none]
    how = np.r_[how, np.full(len(rest), 1), np.full(len(off), 2)]
    order = np.argsort(who, kind="stable")
    fields = [pa.array(v[order], pa.int32(), mask=how[order] == 2) for v in (cy, i0, i1)] + [pa.array(how[order], pa.int32())]
    ends = np.r_[0, np.cumsum(np.bincount(who, minlength=rows))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["iy", "i0", "i1", "how"]))


def spans_column(ring: Column, **grid) -> Column:
    """:func:`grid_spans` as a column."""

    @F.arrow_udf("array<struct<iy:int,i0:int,i1:int,how:int>>")
    def spans(rings: pa.Array) -> pa.Array:
        return grid_spans(rings, **grid)

    return spans(ring)
