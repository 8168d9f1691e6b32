"""Space-time hulls, sections and exposure zones built from daily perimeters.

A perimeter and its support radii stay arrays inside their (event, day) row;
only neighbouring days of one event meet in a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.arrays import let
from ..session import cut_lineage
from . import geometry as G
from . import rings as R
from .joins import as_of_join
from .zones import areas_of_batches

KEY = "fire_id"


def time_hull(daily: DataFrame, *, n_ring: int = 100, n_theta: int = 72, z: str | None = None, ring: str = "ring", day: str = "date") -> DataFrame:
    """Layers of each event's hull: fire_id, layer, z, area_m2, radii (metres by angle).

    The radius at an angle is the support function of the centred ring points.
    Layers are numbered in date order; ``z`` defaults to 1..M. Events with fewer
    than two usable perimeters have no hull.
    """
    w = W.partitionBy(KEY).orderBy("date")
    at = [] if z is None else [F.col(z).cast("double").alias("z")]
    rows = daily.select(KEY, F.col(day).alias("date"), *at, R.hull_column(F.col(ring), n_ring, n_theta).alias("_h")).where(F.col("_h.perimeter") > 0)
    rows = rows.withColumn("layer", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(KEY))).where("_m >= 2")
    level = F.col("layer").cast("double").alias("z") if z is None else "z"
    return rows.select(KEY, "date", "layer", level, F.col("_h.area").alias("area_m2"), F.col("_h.radii").alias("radii"))


def hull_vertices(layers: DataFrame) -> DataFrame:
    """One vertex per layer and angle, in km and days, with normalised time."""
    whole = W.partitionBy(KEY)
    span = F.greatest(F.max("z").over(whole) - F.min("z").over(whole), F.lit(1e-9))
    v = layers.withColumns({"t_norm": (F.col("z") - F.min("z").over(whole)) / span, "n_theta": F.size("radii")})
    v = v.select(KEY, "date", "layer", "z", "t_norm", "n_theta", F.posexplode("radii").alias("theta_idx", "r_m"))
    t = F.col("theta_idx") * 2 * math.pi / F.col("n_theta")
    return v.select(
        KEY, "date", "layer", "z", "t_norm", "theta_idx", (F.col("r_m") * F.cos(t) / 1000).alias("x_km"), (F.col("r_m") * F.sin(t) / 1000).alias("y_km")
    )


def hull_triangles(layers: DataFrame) -> DataFrame:
    """Vertex numbers of the two triangles of every quad between neighbouring layers."""
    w = W.partitionBy(KEY).orderBy("layer")
    i = F.row_number().over(w) - 1
    quads = layers.withColumns({"_i": i, "_t": F.size("radii"), "_more": F.lead("layer").over(w).isNotNull()}).where("_more")
    q = quads.select(KEY, "_i", "_t", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_j"))
    a, b = F.col("_i") * F.col("_t") + F.col("_j"), F.col("_i") * F.col("_t") + F.pmod(F.col("_j") + 1, F.col("_t"))
    tri = lambda *v: F.struct(*[c.alias(n) for n, c in zip(("v1", "v2", "v3"), v)])
    return q.select(KEY, F.explode(F.array(tri(a, b, b + F.col("_t")), tri(a, b + F.col("_t"), a + F.col("_t")))).alias("t")).select(KEY, "t.*")


def hull_metrics(layers: DataFrame) -> DataFrame:
    """scale, days, volume, surface, peak and final footprint per event."""
    w = W.partitionBy(KEY).orderBy("layer")
    nxt = layers.withColumns({"_r2": F.lead("radii").over(w), "_z2": F.lead("z").over(w), "_a2": F.lead("area_m2").over(w)})
    surface = R.surface_column(F.col("radii"), F.col("_r2"), F.col("_z2") - F.col("z"))
    volume = F.coalesce((F.col("area_m2") + F.col("_a2")) / 2 * (F.col("_z2") - F.col("z")), F.lit(0.0)) / 1e6
    rows = nxt.withColumns({"_s": surface, "_v": volume})
    return rows.groupBy(KEY).agg(
        (F.max(F.array_max(F.transform("radii", lambda r: F.abs(r)))) / 1000).alias("scale_km"), F.count(F.lit(1)).cast("double").alias("duration_days"),
        F.sum("_v").alias("hull_volume_km2_days"), F.sum("_s").alias("hull_surface_km_day"),
        (F.max("area_m2") / 1e6).alias("footprint_area_peak_km2"), (F.max_by("area_m2", "layer") / 1e6).alias("footprint_area_final_km2"),
    )


def smooth_hull(layers: DataFrame, k: int) -> DataFrame:
    """Moving mean of the radii over k layers (odd), edge layers repeated outward."""
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be a positive odd number")
    h = k // 2
    w = W.partitionBy(KEY).orderBy("layer")
    around = [F.lag("radii", s).over(w) for s in range(h, 0, -1)] + [F.col("radii")] + [F.lead("radii", s).over(w) for s in range(1, h + 1)]
    first = F.first("radii").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last("radii").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    filled = [F.coalesce(c, first if i < h else last) for i, c in enumerate(around)]
    tagged = layers.withColumns({f"_n{i}": c for i, c in enumerate(filled)})
    idx = F.sequence(F.lit(0), F.size("radii") - 1)
    mean = F.transform(idx, lambda j: sum((F.get(f"_n{i}", j) for i in range(k)), F.lit(0.0)) / k)
    return tagged.withColumn("radii", mean).drop(*[f"_n{i}" for i in range(k)])


def derivative_hull(vertices: DataFrame, order: int = 1, eps: float = 1e-6) -> DataFrame:
    """Speed (order 1) or acceleration (order 2) of the perimeter as the new radius along the old direction."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    w = W.partitionBy(KEY, "theta_idx").orderBy("layer")

    def gradient(c: str) -> Column:
        back, fwd = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(back.isNull(), fwd - F.col(c)).when(fwd.isNull(), F.col(c) - back).otherwise((fwd - back) / 2)

    v = vertices.withColumns({"_dx": gradient("x_km"), "_dy": gradient("y_km")}).withColumn("_f", F.hypot("_dx", "_dy"))
    if order == 2:
        v = v.withColumn("_f", gradient("_f"))
    r = F.hypot("x_km", "y_km")
    ux, uy = F.when(r > eps, F.col("x_km") / r).otherwise(1.0), F.when(r > eps, F.col("y_km") / r).otherwise(0.0)
    out = v.withColumns({"radius": F.abs("_f"), "_ux": ux, "_uy": uy})
    return out.select(KEY, "layer", "z", "theta_idx", "radius", (F.col("radius") * F.col("_ux")).alias("x_km"), (F.col("radius") * F.col("_uy")).alias("y_km"))


# --- cubes against hulls -----------------------------------------------------


def sample_inside_outside(cube: DataFrame, perimeters: DataFrame, *, dx: float, dy: float) -> DataFrame:
    """Cells of each event's cube inside or outside the perimeter current on their day.

    ``cube``: fire_id, time, x, y, value; ``perimeters``: fire_id, date, ring. A cell
    is inside when the perimeter covers all of it; on days where no cell is, its
    centre decides. Days before the first perimeter are dropped.

    An event's cells of one day travel as one row and meet their perimeter in a forward fill, so no cell is joined; a row is as
    long as the event's grid.
    """
    packed = cube.groupBy(KEY, "time").agg(F.collect_list(F.struct("x", "y", "value")).alias("_c"))
    current = as_of_join(packed, perimeters, key=KEY, day="time", date="date", values=["ring"], keep=["_c"])
    tested = current.select(KEY, "time", "_c", R.inside_column(F.col("ring"), F.col("_c"), dx, dy).alias("_i"))
    cells = tested.select(KEY, "time", F.explode(F.arrays_zip(F.col("_c").alias("c"), F.col("_i").alias("inside"))).alias("s"))
    return cells.select(KEY, "time", "s.c.x", "s.c.y", "s.c.value", "s.inside")


def inside_means(samples: DataFrame) -> DataFrame:
    """Mean inside value per event and day; NULL on days without an inside cell."""
    return samples.groupBy(KEY, "time").agg(F.avg(F.when(F.col("inside"), F.col("value"))).alias("mean_inside"), F.count_if("inside").alias("n_inside"))


def attach_environment(layers: DataFrame, day_means: DataFrame, names: Sequence[str]) -> DataFrame:
    """Day means on the hull's layers by date, filled forward and then backward."""
    w = W.partitionBy(KEY).orderBy("layer")
    back, fwd = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    joined = layers.join(day_means.select(KEY, F.col("time").alias("date"), *names), [KEY, "date"], "left")
    return joined.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(back), F.first(n, ignorenulls=True).over(fwd)) for n in names})


def climate_histogram(samples: DataFrame, bins: int = 40) -> DataFrame:
    """Counts of inside and outside values in equal bins of their common range."""
    # counted by value first: the samples are made once, and both steps after it read counts
    ok = cut_lineage(samples.where("value is not null").groupBy("inside", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    span = ok.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("b")).scalar()
    b = ok.withColumn("_b", span)
    pos = F.coalesce(F.try_divide(F.col("value") - F.col("_b.lo"), F.col("_b.hi") - F.col("_b.lo")), F.lit(0.0)) * bins
    return b.groupBy("inside", F.least(F.floor(F.round(pos, 9)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


# --- sections ----------------------------------------------------------------


def section_at(times: DataFrame, sections: DataFrame, interp: str = "nearest") -> DataFrame:
    """Cross-section ring of each (fire_id, time): nearest section, or vertex-wise linear.

    Sections of one event are packed in time order (one per day at most); times
    outside their range use the first or last one.
    """
    if interp not in {"nearest", "linear"}:
        raise ValueError("interp must be nearest or linear")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    packed = sections.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(day("time").alias("t"), F.col("ring")))).alias("_s"))
    rows = times.select(KEY, "time").distinct().join(packed, KEY).withColumn("_t", day(F.col("time")))
    near = F.array_min(F.transform("_s", lambda s, i: F.struct(F.abs(s["t"] - F.col("_t")).alias("d"), i.alias("i"))))["i"]
    if interp == "nearest":
        return rows.select(KEY, "time", F.get("_s", near)["ring"].alias("ring"))
    below, above = F.filter("_s", lambda s: s["t"] <= F.col("_t")), F.filter("_s", lambda s: s["t"] > F.col("_t"))
    rows = rows.withColumns({"_lo": F.get(below, F.size(below) - 1), "_hi": F.get(above, F.lit(0))})
    f = (F.col("_t") - F.col("_lo.t")) / (F.col("_hi.t") - F.col("_lo.t"))
    same = F.size("_lo.ring") == F.size("_hi.ring")
    mixed = F.zip_with("_lo.ring", "_hi.ring", lambda a, b: G.point(a["x"] + (b["x"] - a["x"]) * f, a["y"] + (b["y"] - a["y"]) * f))
    layout = F.raise_error(F.lit("linear sections need the same number of vertices")).cast(G.RING)
    ring = (
        F.when(F.col("_lo").isNull(), F.col("_hi.ring")).when(F.col("_hi").isNull(), F.col("_lo.ring"))
        .when(F.col("_t") == F.col("_lo.t"), F.col("_lo.ring")).when(same, mixed).otherwise(layout)
    )
    return rows.select(KEY, "time", ring.alias("ring"))


def vase_mask(cube: DataFrame, sections: DataFrame, interp: str = "nearest") -> DataFrame:
    """Cube rows (fire_id, time, x, y, value) with ``inside``: in or on the section of their day."""
    rings = section_at(cube, sections, interp)
    joined = cube.join(rings, [KEY, "time"], "left")
    box = G.extent(F.col("ring"))
    near = F.col("x").between(box["x0"], box["x1"]) & F.col("y").between(box["y0"], box["y1"])
    return joined.withColumn("inside", C.is_true(near & G.covers(F.col("ring"), F.col("x"), F.col("y")))).drop("ring")


def vase_extract(cube: DataFrame, sections: DataFrame, interp: str = "nearest") -> DataFrame:
    """The cube with values outside the vase set to NULL."""
    return vase_mask(cube, sections, interp).withColumn("value", F.when(F.col("inside"), F.col("value")))


def vase_panels(sections: DataFrame, angle_samples: int = 24) -> DataFrame:
    """Quad panels between successive sections in normalised coordinates."""
    whole = W.partitionBy(KEY)
    w = whole.orderBy("time")
    box = G.extent(F.col("ring"))
    t = F.datediff("time", F.lit("1970-01-01").cast("date")).cast("double")
    s = sections.withColumns({"_p": G.sample_ring(F.col("ring"), angle_samples), "_t": t})
    s = s.withColumns({"_x0": F.min(box["x0"]).over(whole), "_x1": F.max(box["x1"]).over(whole), "_y0": F.min(box["y0"]).over(whole), "_y1": F.max(box["y1"]).over(whole), "_t0": F.min("_t").over(whole), "_t1": F.max("_t").over(whole)})
    unit = lambda v, lo, hi: F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.5))
    s = s.withColumns({"_q": F.lead("_p").over(w), "_z": unit(F.col("_t"), F.col("_t0"), F.col("_t1"))}).withColumn("_z2", F.lead("_z").over(w)).where("_q is not null")
    n = F.size("_p")
    at = lambda arr, i, f: (F.get(arr, i)[f] + F.get(arr, F.pmod(i + 1, n))[f]) / 2
    mids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("panel"), at("_p", i, "x").alias("lx"), at("_p", i, "y").alias("ly"), at("_q", i, "x").alias("ux"), at("_q", i, "y").alias("uy")))
    p = s.select("*", F.explode(mids).alias("m")).select("*", "m.*")
    dx, dy = F.col("lx") - F.col("ux"), F.col("ly") - F.col("uy")
    size = F.hypot(dx, dy)
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    return p.select(
        KEY, "time", "panel", unit((F.col("lx") + F.col("ux")) / 2, F.col("_x0"), F.col("_x1")).alias("x"), unit((F.col("ly") + F.col("uy")) / 2, F.col("_y0"), F.col("_y1")).alias("y"),
        ((F.col("_z") + F.col("_z2")) / 2).alias("z"), F.coalesce(F.try_divide(size, span), F.lit(0.5)).alias("width"), F.abs(F.col("_z2") - F.col("_z")).alias("height"),
        F.when(size > 0, F.degrees(F.atan2(dy, dx))).otherwise(0.0).alias("yaw"),
    )


# --- exposure ----------------------------------------------------------------


def exposure_zones(daily: DataFrame, distances: Sequence[float], cell: float = 1000.0, ring: str = "ring", day: str = "date") -> DataFrame:
    """Active, cumulative and exterior-buffer zones per event and day as grid cells.

    Columns: fire_id, date, exposure_zone, extension_distance_m, cx, cy. Zones are
    cell approximations: cumulative holds the cells active on this or an earlier
    day, an extension the other cells whose centre is within the distance of a
    cumulative cell's centre.
    """
    active = G.ring_cells(daily, [KEY, day], ring, cell)
    first = active.groupBy(KEY, "cx", "cy").agg(F.min(day).alias("_since"))
    days = daily.select(KEY, day).distinct()
    # a cell joins every later day of its event: the size of the result itself
    cumulative = first.join(days, KEY).where(F.col(day) >= F.col("_since")).select(KEY, day, "cx", "cy")
    tag = lambda df, zone, d: df.select(KEY, day, F.lit(zone).alias("exposure_zone"), F.lit(float(d)).alias("extension_distance_m"), "cx", "cy")
    out = tag(active, "active", 0).unionByName(tag(cumulative, "cumulative", 0))
    for d in distances:
        h = int(d // cell)
        offsets = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if (i, j) != (0, 0) and math.hypot(i, j) * cell <= d]
        if not offsets:
            continue
        step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
        # a cell enters the buffer on the first day one of its neighbours burns
        reach = first.select(KEY, "_since", "cx", "cy", step.alias("o")).groupBy(KEY, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).agg(F.min("_since").alias("_near"))
        around = reach.join(first, [KEY, "cx", "cy"], "left").join(days, KEY)
        ring_out = around.where((F.col(day) >= F.col("_near")) & (F.col("_since").isNull() | (F.col(day) < F.col("_since"))))
        out = out.unionByName(tag(ring_out, "extension", d))
    return out


def zone_areas(zones: DataFrame, cell: float = 1000.0) -> DataFrame:
    by = [c for c in zones.columns if c not in ("cx", "cy")]
    return zones.groupBy(*by).agg((F.count(F.lit(1)) * cell * cell / 1e6).alias("exposure_area_km2"))


def _merged(lows: pd.Series, highs: pd.Series, days: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of its row, first cell, cell after the last and day of the unions of each row's spans of one day, all rows at once."""
    row = np.repeat(np.arange(len(lows)), lows.str.len().to_numpy(np.int64))
    lo, hi, when = (np.concatenate(x.to_list()).astype(np.int64) for x in (lows, highs, days))
    hi = hi + 1
    order = np.lexsort((lo, when, row))
    row, lo, hi, when = row[order], lo[order], hi[order], when[order]
    group = np.cumsum(np.r_[0, (row[1:] != row[:-1]) | (when[1:] != when[:-1])])
    far = group * (int(hi.max()) - int(lo.min()) + 1)  # lays the groups side by side, none reaching the next
    reach = np.maximum.accumulate(hi + far)
    starts = np.flatnonzero(np.r_[True, (lo + far)[1:] > reach[:-1]] | np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(lo)] - 1
    return row[starts], lo[starts], (reach - far)[ends], when[starts]


def _first_runs(lows: pd.Series, highs: pd.Series, days: pd.Series) -> pd.Series:
    """Of the spans of one row of cells: stretches of cells that are first covered on one day, in order."""
    made = []
    if not len(lows):
        return pd.Series(made)
    row, *spans = _merged(lows, highs, days)
    at = np.searchsorted(row, np.arange(len(lows) + 1))
    for i0, i1 in zip(at[:-1], at[1:]):
        lo, hi, when = (x[i0:i1] for x in spans)
        edges = np.unique(np.r_[lo, hi])
        none = np.iinfo(np.int64).max
        first = np.full(len(edges) - 1, none)
        begin, end = np.searchsorted(edges, lo), np.searchsorted(edges, hi)
        for i in np.argsort(-when, kind="stable").tolist():  # earlier days overwrite later ones
            first[begin[i] : end[i]] = when[i]
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        stops = np.r_[starts[1:], len(first)]
        made.append([{"x0": int(edges[i]), "x1": int(edges[j]) - 1, "s": int(first[i])} for i, j in zip(starts, stops) if first[i] != none])
    return pd.Series(made)


def exposure_areas(daily: DataFrame, distances: Sequence[float], cell: float = 1000.0, ring: str = "ring", day: str = "date") -> DataFrame:
    """Area of every zone of :func:`exposure_zones` per event and day, without its cells or a row for each cell and day.

    An event's perimeters meet once and are painted on a raster of its own (see ``zones``), days bound their number.
    """
    number = F.datediff(day, F.lit("1970-01-01").cast("date")).alias("s")
    events = daily.where(F.col(KEY).isNotNull() & F.col(day).isNotNull()).groupBy(KEY).agg(F.collect_list(F.struct(number, F.col(ring).alias("ring"))).alias("perimeters"))
    names = [KEY, day, "exposure_zone", "extension_distance_m", "exposure_area_km2"]
    kinds = [dict(daily.dtypes)[KEY], "date", "string", "double", "double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from areas_of_batches(batches, distances, cell, names)

    return events.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def zonal_cells(zones: DataFrame, keys: Sequence[str], *, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int, ring: str = "ring") -> DataFrame:
    """Grid cells of each zone with the way they were found.

    Cells whose centre lies strictly inside; else the cell nearest to a
    representative point (``fallback_nearest_cell_to_zone``); a zone whose padded
    box misses the grid gives one row without a cell (``outside_grid``).

    A scanline: the crossings of a grid row with the zone's edges give spans of cells. The cost is rows times edges, all zones
    of a batch at once; a zone leaves its task as spans.
    """
    spans = zones.select(*keys, F.explode(R.spans_column(F.col(ring), x0=x0, dx=dx, nx=nx, y0=y0, dy=dy, ny=ny)).alias("s"))
    method = F.when(F.col("s.how") == 0, "grid_cells_inside_zone").when(F.col("s.how") == 1, "fallback_nearest_cell_to_zone").otherwise("outside_grid")
    return spans.select(*keys, F.explode_outer(F.sequence("s.i0", "s.i1")).alias("ix"), F.col("s.iy").alias("iy"), method.alias("sample_method"))


def zone_exposure_table(zone_cells: DataFrame, grid: DataFrame, keys: Sequence[str], variables: Sequence[str], *, time: str = "date", wind: str | None = None, wind_threshold: float = 0.1) -> DataFrame:
    """mean / minimum / maximum / std (ddof = 0) per zone and variable with its availability.

    ``grid``: time, ix, iy and one column per variable.
    """
    keys = list(keys)
    joined = zone_cells.join(grid.withColumnRenamed("time", time), [time, "ix", "iy"], "left")
    aggs = [C.comma_list("sample_method").alias("climate_sample_method")]
    for v in variables:
        x = C.finite(v)
        aggs += [F.count(x).alias(f"_n_{v}"), F.avg(x).alias(f"{v}_mean"), F.min(x).alias(f"{v}_minimum"), F.max(x).alias(f"{v}_maximum"), F.stddev_pop(x).alias(f"{v}_std")]
    out = joined.groupBy(*keys).agg(*aggs)
    cells = [F.col(f"_n_{v}") for v in variables]
    ok = C.all_present([f"{v}_mean" for v in variables])
    cols = {
        "sample_cell_count": F.greatest(*cells) if len(cells) > 1 else cells[0], "climate_available": ok,
        "climate_failure_reason": F.when(~ok, F.lit("outside_gridmet_coverage_or_missing_value")),
    }
    if wind is not None:
        cols["wind_present"] = C.is_true(F.col(f"{wind}_mean") > wind_threshold)
    return out.withColumns(cols).drop(*[f"_n_{v}" for v in variables])


def event_panel(daily: DataFrame, *, n_ring: int = 60, n_theta: int = 36, ring: str = "ring", day: str = "date") -> tuple[DataFrame, DataFrame]:
    """Hull metrics of every event in one plan, and one failure row per event without a hull."""
    layers = time_hull(daily, n_ring=n_ring, n_theta=n_theta, ring=ring, day=day)
    metrics = hull_metrics(layers)
    per = daily.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(ring) >= 3).alias("n_usable"))
    reason = F.when(F.col("n_usable") == 0, "no usable perimeter").otherwise("fewer than two usable perimeters")
    failures = per.where("n_usable < 2").select(KEY, "n_rows", reason.alias("reason"))
    return metrics, failures
