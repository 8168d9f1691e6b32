"""Rings (arrays of x, y points in plane units) as columns: measures, tests, sampling.

A ring lives in its row, so measuring it needs no shuffle. Rings are open: the
last point joins the first. All functions are vertex folds inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.arrays import let

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def regular_ring(x: Column, y: Column, radius: Column, n: int) -> Column:
    return F.array(*[point(x + radius * math.cos(2 * math.pi * i / n), y + radius * math.sin(2 * math.pi * i / n)) for i in range(n)])


def open_ring(ring: Column) -> Column:
    """Drop the closing vertex when it repeats the first one."""
    n = F.size(ring)
    closed = (n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    return F.when(closed, F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(ring)


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs, the last one back to the first."""

    def pairs(r: Column) -> Column:
        nxt = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(1), F.lit(1)))
        return F.zip_with(r, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(ring, pairs)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + f(v))


def _local(ring: Column) -> Column:
    """Ring moved to its first vertex (sums lose no digits), with that vertex and the local edges."""

    def move(r: Column) -> Column:
        first = F.get(r, F.lit(0))
        return let(first, lambda o: F.struct(o.alias("o"), edges(F.transform(r, lambda p: point(p["x"] - o["x"], p["y"] - o["y"]))).alias("e")))

    return let(ring, move)


def signed_area(ring: Column) -> Column:
    return let(_local(ring), lambda s: _sum(s["e"], _cross) / 2.0)


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def extent(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}


def centroid(ring: Column) -> tuple[Column, Column]:
    def middle(s: Column) -> Column:
        sums = F.struct(
            (3.0 * _sum(s["e"], _cross)).alias("a"), _sum(s["e"], lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e)).alias("x"),
            _sum(s["e"], lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e)).alias("y"),
        )
        return let(sums, lambda t: point(s["o"]["x"] + C.ratio(t["x"], t["a"]), s["o"]["y"] + C.ratio(t["y"], t["a"])))

    c = let(_local(ring), middle)
    return c["x"], c["y"]


def ring_metrics(ring: Column) -> dict[str, Column]:
    """area, perimeter, compactness 4 pi A / P^2, bbox diagonal and longer side, centroid."""
    area, length, box = F.abs(signed_area(ring)), perimeter(ring), extent(ring)
    dx, dy = box["x1"] - box["x0"], box["y1"] - box["y0"]
    cx, cy = centroid(ring)
    return {
        "area": area, "perimeter": length, "compactness": C.ratio(4 * math.pi * area, length * length),
        "diagonal": F.hypot(dx, dy), "width": F.greatest(dx, dy), "cx": cx, "cy": cy,
    }


def largest_part(parts: Column) -> Column:
    """Largest-area ring of a multi-part geometry (the first on ties)."""
    scored = F.transform(parts, lambda r, i: F.struct(F.round(F.abs(signed_area(r)), 9).alias("a"), (-i).alias("i"), r.alias("r")))
    return F.array_max(scored)["r"]


def on_edges(edge_list: Column, x: Column, y: Column, eps: float = 1e-9) -> Column:
    """Is the point on one of the edges?"""

    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        side = F.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax))
        along = x.between(F.least(ax, bx) - eps, F.greatest(ax, bx) + eps) & y.between(F.least(ay, by) - eps, F.greatest(ay, by) + eps)
        return along & (side <= eps * F.greatest(F.hypot(bx - ax, by - ay), F.lit(1.0)))

    return F.exists(edge_list, touches)


def in_edges(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd ray test; points exactly on an edge may go either way."""

    def crossing(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        at = (bx - ax) * F.coalesce(F.try_divide(y - ay, by - ay), F.lit(0.0)) + ax
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edge_list, F.lit(0), lambda acc, e: acc + crossing(e)) % 2 == 1


def _covers_edges(e: Column, x: Column, y: Column) -> Column:
    return in_edges(e, x, y) | on_edges(e, x, y)


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return let(edges(ring), lambda e: _covers_edges(e, x, y))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside."""
    return let(edges(ring), lambda e: in_edges(e, x, y) & ~on_edges(e, x, y))


def covers_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the ring cover the whole box? All corners inside and no edge or vertex inside the box."""

    def cuts(e: Column) -> Column:
        # clip the edge to the open box (Liang-Barsky); a remaining part means the boundary enters it
        ax, ay = e["a"]["x"], e["a"]["y"]
        dx, dy = e["b"]["x"] - ax, e["b"]["y"] - ay
        lo, hi, dead = F.lit(0.0), F.lit(1.0), F.lit(False)
        for d, low, high in ((dx, x0 - ax, x1 - ax), (dy, y0 - ay, y1 - ay)):
            t0, t1 = F.try_divide(low, d), F.try_divide(high, d)
            lo = F.greatest(lo, F.least(t0, t1))
            hi = F.least(hi, F.greatest(t0, t1))
            dead = dead | ((F.abs(d) < 1e-15) & ((low >= 0) | (high <= 0)))
        return ~dead & (hi - lo > 1e-12)

    def whole(e: Column) -> Column:
        corners = _covers_edges(e, x0, y0) & _covers_edges(e, x1, y0) & _covers_edges(e, x1, y1) & _covers_edges(e, x0, y1)
        return corners & ~F.exists(e, cuts)

    return let(edges(ring), whole)


def representative_point(ring: Column) -> Column:
    """A point (struct) inside the ring: middle of the widest span of a scanline near mid-height."""
    box = extent(ring)
    ys = F.transform(ring, lambda p: p["y"])
    seed = F.struct(
        ys.alias("ys"), ((box["y0"] + box["y1"]) / 2).alias("mid"), box["y0"].alias("y0"), box["y1"].alias("y1"), ((box["x0"] + box["x1"]) / 2).alias("mx"), edges(ring).alias("e")
    )

    def scanline(s: Column) -> Column:
        below = F.coalesce(F.array_max(F.filter(s["ys"], lambda v: v <= s["mid"])), s["y0"])
        above = F.coalesce(F.array_min(F.filter(s["ys"], lambda v: v > s["mid"])), s["y1"])
        return let(F.struct(((below + above) / 2).alias("y"), s["e"].alias("e"), s["mx"].alias("mx")), crossings)

    def crossings(s: Column) -> Column:
        cut = F.filter(s["e"], lambda e: (e["a"]["y"] > s["y"]) != (e["b"]["y"] > s["y"]))
        at = lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * F.coalesce(F.try_divide(s["y"] - e["a"]["y"], e["b"]["y"] - e["a"]["y"]), F.lit(0.0))
        return let(F.array_sort(F.transform(cut, at)), lambda xs: point(F.coalesce(widest(xs), s["mx"]), s["y"]))

    def widest(xs: Column) -> Column:
        pairs = F.when(F.size(xs) >= 2, F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        spans = F.transform(pairs, lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("m")))
        return F.array_max(spans)["m"]

    return let(seed, scanline)


def sample_ring(ring: Column, n: int, *, closed: bool = True) -> Column:
    """n points at equal steps of arc length from the first vertex.

    ``closed=False`` leaves the closing segment out of the path (hulls);
    ``closed=True`` walks the whole ring (sections, at least 4 points).
    """
    if closed:
        n = max(4, int(n))
    path = edges(ring) if closed else F.slice(edges(ring), F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    length = lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<s:double,l:double,a:struct<x:double,y:double>,b:struct<x:double,y:double>>>").alias("segs"))
    walked = F.aggregate(
        path, start,
        lambda acc, e: F.struct(
            (acc["s"] + length(e)).alias("s"),
            F.array_append(acc["segs"], F.struct(acc["s"].alias("s"), length(e).alias("l"), e["a"].alias("a"), e["b"].alias("b"))).alias("segs"),
        ),
    )

    def on_segment(seg: Column, d: Column) -> Column:
        f = F.coalesce(F.try_divide(d - seg["s"], seg["l"]), F.lit(0.0))
        return point(seg["a"]["x"] + (seg["b"]["x"] - seg["a"]["x"]) * f, seg["a"]["y"] + (seg["b"]["y"] - seg["a"]["y"]) * f)

    def at(walk: Column, i: int) -> Column:
        d = walk["s"] * i / float(n)
        passed = F.filter(walk["segs"], lambda s: (s["s"] <= d + 1e-12) & (s["l"] > 0))
        return let(F.element_at(passed, F.lit(-1)), lambda seg: on_segment(seg, d))

    return let(walked, lambda walk: F.array(*[at(walk, i) for i in range(n)]))


def clean_event_rows(daily: DataFrame, key: str = "fire_id", day: str = "date", ring: str = "ring") -> DataFrame:
    """Sorted rows without empty geometry and without a perimeter equal to the previous one."""
    kept = daily.where(F.size(ring) >= 3).withColumn("_h", F.sha2(F.to_json(F.col(ring)), 256))
    w = W.partitionBy(key).orderBy(day)
    return kept.withColumn("_p", F.lag("_h").over(w)).where(~F.col("_h").eqNullSafe(F.col("_p"))).drop("_h", "_p")


def cells_of_ring(x0: Column, x1: Column, y0: Column, y1: Column, cell: float) -> Column:
    """Integer grid cells whose centre can lie inside a box."""
    span = lambda a, b: F.sequence(F.floor(a / cell).cast("bigint"), F.floor(b / cell).cast("bigint"))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def ring_cells(df: DataFrame, keys: list[str], ring: str, cell: float) -> DataFrame:
    """Rows (keys, cx, cy) for the grid cells whose centre the ring covers."""
    box = extent(F.col(ring))
    spread = df.select(*keys, ring, F.explode(cells_of_ring(box["x0"], box["x1"], box["y0"], box["y1"], cell)).alias("c"))
    cx, cy = (F.col("c.cx") + 0.5) * cell, (F.col("c.cy") + 0.5) * cell
    return spread.where(covers(F.col(ring), cx, cy)).select(*keys, "c.cx", "c.cy")


def build_events(daily: DataFrame, key: str = "fire_id", day: str = "date", ring: str = "ring", cell: float = 1000.0) -> DataFrame:
    """event id, t0, t1 and the centroid of the union of all its perimeters.

    The union is taken on grid cells of size ``cell`` (an approximation for
    overlapping perimeters); an event smaller than a cell falls back to the
    area-weighted ring centroid.
    """
    rows = clean_event_rows(daily, key, day, ring)
    cx, cy = centroid(F.col(ring))
    area = F.abs(signed_area(F.col(ring)))
    w = rows.select(key, day, area.alias("_a"), cx.alias("_x"), cy.alias("_y"))
    per = w.groupBy(key).agg(
        F.min(day).alias("t0"), F.max(day).alias("t1"), F.count(F.lit(1)).alias("n_perimeters"),
        C.ratio(F.sum(F.col("_x") * F.col("_a")), F.sum("_a")).alias("_wx"), C.ratio(F.sum(F.col("_y") * F.col("_a")), F.sum("_a")).alias("_wy"),
    )
    union = ring_cells(rows, [key], ring, cell).distinct().groupBy(key).agg(
        (F.avg(F.col("cx") + 0.5) * cell).alias("_ux"), (F.avg(F.col("cy") + 0.5) * cell).alias("_uy")
    )
    return per.join(union, key, "left").select(
        key, "t0", "t1", "n_perimeters", F.coalesce("_ux", "_wx").alias("centroid_x"), F.coalesce("_uy", "_wy").alias("centroid_y")
    )
