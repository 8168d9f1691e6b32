"""Areas of exposure zones for the events of a whole Arrow batch at once.

An event's perimeters are painted on a raster that says for each cell on which of its days it burns first. What lies within a distance
then is the least day over a disk of cells, taken by shifts of the raster; rasters of one shape are stacked, so that a shift moves many
events. An event wider than TILE cells is cut into tiles with a margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from .rings import EPS, Rings, _spans, in_steps, lengths

#: Cells along a raster that is not cut, cells of rasters that are stacked, step of their shapes.
TILE, CELLS, STEP = 1024, 1 << 21, 8


def covered_runs(r: Rings, cell: float) -> tuple[np.ndarray, ...]:
    """Ring, row and first cell and cell after the last of the stretches of cells whose centres a ring covers (some of a row may overlap)."""
    at_cell = lambda v: np.round(v / cell - 0.5, 9)
    _, _, low, high = r.extent()
    low, high = np.ceil(at_cell(low)), np.floor(at_cell(high))
    some = np.flatnonzero(np.isfinite(low) & np.isfinite(high) & (low <= high))
    lines = (high - low + 1)[some].astype(np.int64)
    ring = np.repeat(some, lines)
    cy = np.arange(len(ring)) - np.repeat(np.cumsum(lines) - lines, lines) + np.repeat(low[some].astype(np.int64), lines)
    found = [(np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2]
    for part in in_steps(r.n[ring]):
        y = (cy[part] + 0.5) * cell
        at, e = r.edges_of(ring[part])
        line, left, right = _spans(r, y, at, e)
        level = np.flatnonzero(np.abs(r.y[e] - y[at]) <= EPS)  # the line runs along the ring, or touches it
        a, on = r.x[e[level]], at[level]
        b = np.where(np.abs(r.by[e[level]] - y[on]) <= EPS, r.bx[e[level]], a)
        line, left, right = np.r_[line, on], np.r_[left, np.minimum(a, b)], np.r_[right, np.maximum(a, b)]
        found.append((ring[part][line], cy[part][line], np.ceil(at_cell(left)), np.floor(at_cell(right))))
    ring, cy, lo, hi = (np.concatenate(x) for x in zip(*found))
    some = lo <= hi
    return ring[some], cy[some], lo[some].astype(np.int64), hi[some].astype(np.int64) + 1


def _merged(row: np.ndarray, cy: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unions of the stretches of each (row, cy), in order."""
    order = np.lexsort((lo, cy, row))
    row, cy, lo, hi = row[order], cy[order], lo[order], hi[order]
    if not len(row):
        return row, cy, lo, hi
    new = np.r_[True, (row[1:] != row[:-1]) | (cy[1:] != cy[:-1])]
    far = np.cumsum(new) * (int(hi.max()) - int(lo.min()) + 1)  # lays the groups side by side, none reaching the next
    reach = np.maximum.accumulate(hi + far)
    starts = np.flatnonzero(new | np.r_[True, (lo + far)[1:] > reach[:-1]])
    ends = np.r_[starts[1:], len(lo)] - 1
    return row[starts], cy[starts], lo[starts], (reach - far)[ends]


def _disks(distances: Sequence[float], cell: float) -> dict[int, list[tuple[int, int]]]:
    """By half width the rows of the disks that are so wide: number of the distance, rows up or down."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i, d in enumerate(distances):
        for j in range(int(d // cell) + 1):
            out.setdefault(int(math.sqrt((d / cell) ** 2 - j * j) + 1e-9), []).append((i, j))
    return out


def _shifted(into: np.ndarray, from_: np.ndarray, by: int, axis: int) -> None:
    """``into`` becomes the lesser of itself and of ``from_`` moved both ways along an axis."""
    n = into.shape[axis]
    if by < n:
        head, tail = [slice(None)] * 3, [slice(None)] * 3
        head[axis], tail[axis] = slice(0, n - by), slice(by, n)
        head, tail = tuple(head), tuple(tail)
        np.minimum(into[head], from_[tail], out=into[head])
        if by:
            np.minimum(into[tail], from_[head], out=into[tail])


class _Counts:
    """Cells by the day row on which they burn first (column 0) or come within each distance."""

    def __init__(self, rows: int, distances: Sequence[float], cell: float):
        self.found = np.zeros((1 + len(distances), rows), np.int64)
        self.disks = _disks(distances, cell)
        self.margin = max([int(d // cell) for d in distances], default=0)

    def stack(self, first: np.ndarray, oy: np.ndarray, ox: np.ndarray, shape: tuple[int, int], item: np.ndarray, row: np.ndarray, cy: np.ndarray, lo: np.ndarray, hi: np.ndarray, edge: int = 0) -> None:
        """Count the cells of rasters of one shape but for ``edge`` cells along the sides. ``first``: day row of each one's first day; spans in order of their rows."""
        high, wide, n = *shape, len(first)
        none = np.iinfo(np.int32).max
        days = int((row - first[item]).max(initial=0))
        kind = np.int16 if days < np.iinfo(np.int16).max else np.int32
        none = np.iinfo(kind).max
        raster = np.full((high, wide, n), none, kind)
        flat, order = raster.reshape(-1), np.arange(len(row))[::-1]  # earlier days come later and stay
        for part in in_steps((hi - lo)[order]):
            at = order[part]
            many = (hi - lo)[at]
            x = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - (lo - ox[item])[at], many)
            flat[(np.repeat((cy - oy[item])[at], many) * wide + x) * n + np.repeat(item[at], many)] = np.repeat((row - first[item])[at].astype(kind), many)
        near = [np.full_like(raster, none) for _ in range(len(self.found) - 1)]
        across = raster.copy()
        for w in range(max(self.disks, default=-1) + 1):
            if w:
                _shifted(across, raster, w, 1)
            for i, j in self.disks.get(w, ()):
                _shifted(near[i], across, j, 0)
        inner = slice(edge, high - edge), slice(edge, wide - edge)
        for count, days in zip(self.found, [raster, *near]):
            days = days[inner]
            at = (days + first[None, None, :])[days < none]
            count += np.bincount(at, minlength=len(count))


def zone_counts(events: int, of: np.ndarray, row: np.ndarray, cy: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, rows: int, distances: Sequence[float], cell: float) -> np.ndarray:
    """Cells that burn, or come within each distance, first on each day row. ``of``: event of each span, in order; ``first``: first day row of each event."""
    counts = _Counts(rows, distances, cell)
    if not len(of):
        return counts.found
    m = counts.margin
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    have, end = of[begin], np.r_[begin[1:], len(of)]
    oy, ox = np.minimum.reduceat(cy, begin) - m, np.minimum.reduceat(lo, begin) - m
    high, wide = np.maximum.reduceat(cy, begin) + m + 1 - oy, np.maximum.reduceat(hi, begin) + m - ox
    small = (high <= TILE) & (wide <= TILE)
    shapes = -(-np.c_[high, wide] // STEP) * STEP
    kinds, kind = np.unique(shapes[small], axis=0, return_inverse=True)
    kind, whole = kind.reshape(-1), np.flatnonzero(small)
    for k, shape in enumerate(kinds.tolist()):
        members = whole[kind == k]
        step = max(1, CELLS // (shape[0] * shape[1]))
        for i in range(0, len(members), step):
            mine = members[i : i + step]
            many = (end - begin)[mine]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - begin[mine], many)
            counts.stack(first[have[mine]], oy[mine], ox[mine], tuple(shape), np.repeat(np.arange(len(mine)), many), row[at], cy[at], lo[at], hi[at])
    for i in np.flatnonzero(~small):
        span = slice(begin[i], end[i])
        r_, y_, a_, b_ = row[span], cy[span], lo[span], hi[span]
        for ty in range(int(oy[i]), int(oy[i] + high[i]), TILE):
            near_y = (y_ >= ty - m) & (y_ < ty + TILE + m)
            for tx in range(int(ox[i]), int(ox[i] + wide[i]), TILE) if near_y.any() else ():
                at = np.flatnonzero(near_y & (b_ > tx - m) & (a_ < tx + TILE + m))
                if len(at):
                    side = TILE + 2 * m
                    cut = np.maximum(a_[at], tx - m), np.minimum(b_[at], tx + TILE + m)
                    counts.stack(first[have[i]][None], np.array([ty - m]), np.array([tx - m]), (side, side), np.zeros(len(at), np.int64), r_[at], y_[at], *cut, edge=m)
    return counts.found


def areas_of_batches(batches: Iterator[pa.RecordBatch], distances: Sequence[float], cell: float, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Of batches of (key, perimeters as a list of (day number, ring)), a row an event, day and zone: key, day, zone, distance, area in square km."""
    for b in batches:
        many = lengths(b.column(1))
        entries = b.column(1).flatten()
        event, day = np.repeat(np.arange(len(many)), many), entries.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        of_row, at = np.unique(event << 32 | day + (1 << 31), return_inverse=True)
        row_event, row_day = of_row >> 32, (of_row & (1 << 32) - 1) - (1 << 31)
        first = np.searchsorted(row_event, np.arange(len(many)))
        ring, cy, lo, hi = covered_runs(Rings.of(entries.field(1)), cell)
        row, cy, lo, hi = _merged(at[ring], cy, lo, hi)
        rows = len(of_row)
        active = np.bincount(row, (hi - lo).astype(float), rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        burnt, *near = np.cumsum(zone_counts(len(many), row_event[row], row, cy, lo, hi, first, rows, distances, cell), axis=1)
        before = lambda c: c - np.r_[0, c][first][row_event]
        zones = [("active", 0.0, active), ("cumulative", 0.0, before(burnt)), *[("extension", float(d), before(x) - before(burnt)) for d, x in zip(distances, near)]]
        for zone, d, n in zones:
            some = np.flatnonzero(n > 0)
            columns = [b.column(0).take(pa.array(row_event[some])), pa.array(row_day[some].astype(np.int32)).cast(pa.date32())]
            columns += [pa.array([zone] * len(some), pa.string()), pa.array(np.full(len(some), d)), pa.array(n[some] * (cell * cell / 1e6))]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))
