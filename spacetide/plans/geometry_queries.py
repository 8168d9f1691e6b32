"""Perimeters, hulls, sections and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import hull as H
from .inputs import PLACES, RINGS, places, rounded, shaped_slices, table
from .registry import query


def perimeters(spark, d, n=4):
    """Squares (or k-gons) around each event's centre that grow with its area; metres."""
    s = shaped_slices(spark, d).join(places(spark, d).select("fire_id", "lon", "lat"), "fire_id")
    x, y, half = F.round(F.col("lon") * 1000, 3), F.round(F.col("lat") * 1000, 3), F.round(F.sqrt("cumulative_area_km2") * 500, 3)
    ring = G.box_ring(x - half, y - half, x + half, y + half) if n == 4 else G.regular_ring(x, y, half, n)
    return s.select("fire_id", F.col("timestamp").alias("date"), "slice_index", "cumulative_area_km2", x.alias("cx0"), y.alias("cy0"), half.alias("half"), ring.alias("ring"))


_PER = f"""{PLACES}, {RINGS}, per AS (SELECT s.fire_id, s.timestamp AS date, s.slice_index, s.n_obs, round(p.lon * 1000, 3) AS cx, round(p.lat * 1000, 3) AS cy, round(sqrt(s.cumulative_area_km2) * 500, 3) AS h FROM shaped s JOIN places p ON p.fire_id = s.fire_id)"""


@query("clean_event_perimeters", "10.01")
def _(spark, d):
    p = perimeters(spark, d)
    doubled = p.unionByName(p.where("slice_index = 0").withColumn("date", F.date_add("date", 1)))
    return G.clean_event_rows(doubled).select("fire_id", "date", F.size("ring").alias("n"))


@query("events_from_perimeters", "10.02")
def _(spark, d):
    out = G.build_events(perimeters(spark, d), cell=4000.0)
    return rounded(out, "centroid_x", "centroid_y", digits=3)


@query(
    "largest_parts",
    "10.03",
    f"""WITH {_PER} SELECT fire_id, date, round(greatest(4 * h * h, CASE WHEN slice_index % 2 = 0 THEN 16 * h * h ELSE h * h END), 2) AS area FROM per""",
)
def _(spark, d):
    p = perimeters(spark, d)
    x, y, h = F.col("cx0"), F.col("cy0"), F.col("half")
    k = F.when(F.col("slice_index") % 2 == 0, 2.0).otherwise(0.5)
    other = G.box_ring(x + 50000 - h * k, y - h * k, x + 50000 + h * k, y + h * k)
    big = G.largest_part(F.array(F.col("ring"), other))
    return rounded(p.select("fire_id", "date", F.abs(G.signed_area(big)).alias("area")), "area", digits=2)


@query(
    "ring_measures",
    "10.04",
    f"""WITH {_PER} SELECT fire_id, date, round(4 * h * h, 2) AS area, round(8 * h, 5) AS perimeter, round(pi() / 4, 6) AS compactness, round(sqrt(8) * h, 4) AS diagonal, round(cx, 3) AS cx, round(cy, 3) AS cy FROM per""",
)
def _(spark, d):
    m = G.ring_metrics(F.col("ring"))
    out = perimeters(spark, d).select("fire_id", "date", *[m[k].alias(k) for k in ("area", "perimeter", "compactness", "diagonal", "cx", "cy")])
    out = rounded(rounded(rounded(out, "area", digits=2), "cx", "cy", digits=3), "perimeter", digits=5)
    return rounded(rounded(out, "diagonal", digits=4), "compactness")


@query(
    "ring_samples",
    "10.06",
    f"""WITH {_PER}, i AS (SELECT unnest(generate_series(0, 7)) AS k), q AS (SELECT fire_id, date, k, cx, cy, h, k * h AS dist FROM per CROSS JOIN i)
    SELECT fire_id, date, CAST(k AS INTEGER) AS k, round(CASE WHEN k <= 2 THEN cx - h + dist WHEN k <= 4 THEN cx + h WHEN k <= 6 THEN cx + h - (dist - 4 * h) ELSE cx - h END, 3) AS x,
      round(CASE WHEN k <= 2 THEN cy - h WHEN k <= 4 THEN cy - h + (dist - 2 * h) WHEN k <= 6 THEN cy + h ELSE cy + h - (dist - 6 * h) END, 3) AS y FROM q""",
)
def _(spark, d):
    p = perimeters(spark, d).select("fire_id", "date", F.posexplode(G.sample_ring(F.col("ring"), 8)).alias("k", "p"))
    return rounded(p.select("fire_id", "date", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "x", "y", digits=3)


def _layers(spark, d):
    # twelve points along the open path of a square, twelve angles
    return H.time_hull(perimeters(spark, d), n_ring=12, n_theta=12)


# support radius of the twelve path points of a square with half side 1, by angle (path without the closing side)
_HULL = f"""{_PER}, pts AS (SELECT k, CASE WHEN k * 0.5 <= 2 THEN -1 + k * 0.5 WHEN k * 0.5 <= 4 THEN 1 ELSE 1 - (k * 0.5 - 4) END::DOUBLE AS x, CASE WHEN k * 0.5 <= 2 THEN -1 WHEN k * 0.5 <= 4 THEN -1 + (k * 0.5 - 2) ELSE 1 END::DOUBLE AS y FROM (SELECT unnest(generate_series(0, 11)) AS k)),
cen AS (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM pts), th AS (SELECT j, j * 2 * pi() / 12 AS t FROM (SELECT unnest(generate_series(0, 11)) AS j)),
sup AS (SELECT j, t, max(x * cos(t) + y * sin(t)) AS r FROM cen CROSS JOIN th GROUP BY ALL),
lay AS (SELECT fire_id, date, CAST(slice_index + 1 AS INTEGER) AS layer, CAST(slice_index + 1 AS DOUBLE) AS z, h FROM per WHERE n_obs >= 2)"""


@query(
    "hull_vertices",
    "10.07 14.05",
    f"""WITH {_HULL} SELECT fire_id, layer, CAST(j AS INTEGER) AS theta_idx, z, round(h * r * cos(t) / 1000, 8) AS x_km, round(h * r * sin(t) / 1000, 8) AS y_km FROM lay CROSS JOIN sup""",
)
def _(spark, d):
    return rounded(H.hull_vertices(_layers(spark, d)).select("fire_id", "layer", "theta_idx", "z", "x_km", "y_km"), "x_km", "y_km", digits=8)


@query(
    "hull_metrics",
    "10.08",
    f"""WITH {_HULL}, a AS (SELECT *, 4 * h * h AS ar, lead(h) OVER w AS h2, lead(z) OVER w AS z2 FROM lay WINDOW w AS (PARTITION BY fire_id ORDER BY layer)),
    v AS (SELECT l.fire_id, l.layer, s.j, l.h * s.r / 1000 * cos(s.t) AS x1, l.h * s.r / 1000 * sin(s.t) AS y1, l.h * n.r / 1000 * cos(n.t) AS x2, l.h * n.r / 1000 * sin(n.t) AS y2, l.h2 * n.r / 1000 * cos(n.t) AS x3, l.h2 * n.r / 1000 * sin(n.t) AS y3, l.h2 * s.r / 1000 * cos(s.t) AS x4, l.h2 * s.r / 1000 * sin(s.t) AS y4, l.z2 - l.z AS dz
      FROM a l JOIN sup s ON true JOIN sup n ON n.j = (s.j + 1) % 12 WHERE l.h2 IS NOT NULL),
    t AS (SELECT fire_id, 0.5 * sqrt(pow((y2 - y1) * dz, 2) + pow((x2 - x1) * dz, 2) + pow((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1), 2)) + 0.5 * sqrt(pow((y3 - y1) * dz - dz * (y4 - y1), 2) + pow(dz * (x4 - x1) - (x3 - x1) * dz, 2) + pow((x3 - x1) * (y4 - y1) - (y3 - y1) * (x4 - x1), 2)) AS s FROM v),
    sf AS (SELECT fire_id, sum(s) AS s FROM t GROUP BY 1)
    SELECT a.fire_id, round(max(h) * (SELECT max(r) FROM sup) / 1000, 6) AS scale_km, CAST(count(*) AS DOUBLE) AS duration_days, round(sum(coalesce((ar + 4 * h2 * h2) / 2 * (z2 - z), 0)) / 1e6, 4) AS hull_volume_km2_days, round(max(sf.s), 4) AS hull_surface_km_day, round(max(ar) / 1e6, 5) AS footprint_area_peak_km2, round(arg_max(ar, layer) / 1e6, 5) AS footprint_area_final_km2
    FROM a JOIN sf ON sf.fire_id = a.fire_id GROUP BY 1""",
)
def _(spark, d):
    out = H.hull_metrics(_layers(spark, d))
    out = rounded(rounded(out, "scale_km"), "hull_volume_km2_days", "hull_surface_km_day", digits=4)
    return rounded(out, "footprint_area_peak_km2", "footprint_area_final_km2", digits=5)


@query("hull_triangle_count", "10.07", f"WITH {_HULL} SELECT fire_id, CAST((count(*) - 1) * 24 AS BIGINT) AS n, CAST(count(*) * 12 - 1 AS INTEGER) AS top FROM lay GROUP BY 1")
def _(spark, d):
    t = H.hull_triangles(_layers(spark, d))
    return t.groupBy("fire_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("v1", "v2", "v3")).alias("top"))


@query(
    "smoothed_hull",
    "10.09",
    f"""WITH {_HULL}, s AS (SELECT fire_id, layer, coalesce(lag(h) OVER w, first_value(h) OVER w) AS a, h AS b, coalesce(lead(h) OVER w, h) AS c FROM lay WINDOW w AS (PARTITION BY fire_id ORDER BY layer))
    SELECT fire_id, layer, CAST(j AS INTEGER) AS theta_idx, round((a + b + c) / 3 * r, 8) AS radius_m FROM s CROSS JOIN sup""",
)
def _(spark, d):
    out = H.smooth_hull(_layers(spark, d), 3).select("fire_id", "layer", F.posexplode("radii").alias("theta_idx", "radius_m"))
    return rounded(out, "radius_m", digits=8)


@query(
    "speed_hull",
    "10.10",
    f"""WITH {_HULL}, g AS (SELECT fire_id, layer, CASE WHEN lag(h) OVER w IS NULL THEN lead(h) OVER w - h WHEN lead(h) OVER w IS NULL THEN h - lag(h) OVER w ELSE (lead(h) OVER w - lag(h) OVER w) / 2 END AS dh FROM lay WINDOW w AS (PARTITION BY fire_id ORDER BY layer))
    SELECT fire_id, layer, CAST(j AS INTEGER) AS theta_idx, round(abs(dh * r) / 1000, 8) AS radius FROM g CROSS JOIN sup""",
)
def _(spark, d):
    out = H.derivative_hull(H.hull_vertices(_layers(spark, d)), 1)
    return rounded(out.select("fire_id", "layer", "theta_idx", "radius"), "radius", digits=8)


@query("acceleration_hull", "10.10")
def _(spark, d):
    out = H.derivative_hull(H.hull_vertices(_layers(spark, d)), 2)
    return rounded(out.select("fire_id", "layer", "theta_idx", "radius"), "radius")


def _event_cube(spark, d):
    """A 5 km grid of 5 x 5 cells around every event on each of its order days."""
    p = perimeters(spark, d)
    steps = F.sequence(F.lit(-2), F.lit(2))
    c = p.select("fire_id", F.col("date").alias("time"), "cx0", "cy0", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    value = F.pmod(F.col("i") * 7 + F.col("j") * 3 + F.dayofyear("time"), F.lit(50)).cast("double")
    return c.select("fire_id", "time", (F.col("cx0") + F.col("i") * 5000).alias("x"), (F.col("cy0") + F.col("j") * 5000).alias("y"), value.alias("value"))


_CELLS = f"""{_PER}, cells AS (SELECT fire_id, date AS time, cx, cy, h, i, j, CAST((i * 7 + j * 3 + dayofyear(date) + 500) % 50 AS DOUBLE) AS value FROM per CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS i) CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS j)),
full_in AS (SELECT *, abs(i) * 5000 + 2500 <= h + 1e-9 AND abs(j) * 5000 + 2500 <= h + 1e-9 AS fl, abs(i) * 5000 <= h + 1e-9 AND abs(j) * 5000 <= h + 1e-9 AS ce FROM cells)"""


@query(
    "inside_outside_means",
    "10.11",
    f"""WITH {_CELLS}, k AS (SELECT *, bool_or(fl) OVER (PARTITION BY fire_id, time) AS af FROM full_in), s AS (SELECT *, CASE WHEN af THEN fl ELSE ce END AS inside FROM k)
    SELECT fire_id, time, round(avg(value) FILTER (inside), 6) AS mean_inside, CAST(count(*) FILTER (inside) AS BIGINT) AS n_inside FROM s GROUP BY ALL""",
)
def _(spark, d):
    s = H.sample_inside_outside(_event_cube(spark, d), perimeters(spark, d).select("fire_id", "date", "ring"), dx=5000.0, dy=5000.0)
    return rounded(H.inside_means(s), "mean_inside")


@query(
    "inside_outside_histogram",
    "10.13",
    f"""WITH {_CELLS}, k AS (SELECT *, bool_or(fl) OVER (PARTITION BY fire_id, time) AS af FROM full_in), s AS (SELECT value, CASE WHEN af THEN fl ELSE ce END AS inside FROM k), b AS (SELECT min(value) AS lo, max(value) AS hi FROM s)
    SELECT inside, CAST(least(floor(round((value - lo) / (hi - lo) * 10, 9)), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM s, b GROUP BY ALL""",
)
def _(spark, d):
    s = H.sample_inside_outside(_event_cube(spark, d), perimeters(spark, d).select("fire_id", "date", "ring"), dx=5000.0, dy=5000.0)
    return H.climate_histogram(s, 10)


@query(
    "hull_environment",
    "10.12",
    f"""WITH {_HULL}, m AS (SELECT fire_id, layer, date, CASE WHEN layer % 3 = 2 THEN round(sqrt(layer) * 10, 6) END AS v FROM lay),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY fire_id ORDER BY layer) AS a, first_value(v IGNORE NULLS) OVER (PARTITION BY fire_id ORDER BY layer ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM m)
    SELECT fire_id, layer, coalesce(a, b) AS vpd FROM f""",
)
def _(spark, d):
    layers = _layers(spark, d)
    means = layers.where("layer % 3 = 2").select("fire_id", F.col("date").alias("time"), F.round(F.sqrt("layer") * 10, 6).alias("vpd"))
    return H.attach_environment(layers, means, ["vpd"]).select("fire_id", "layer", "vpd")


@query(
    "vase_mask_nearest",
    "10.14",
    f"""WITH {_CELLS}, o AS (SELECT fire_id, date, h FROM per WHERE slice_index % 2 = 0),
    d AS (SELECT c.fire_id, c.time, (SELECT o.h FROM o WHERE o.fire_id = c.fire_id ORDER BY abs(date_diff('day', o.date, c.time)), o.date LIMIT 1) AS hh FROM (SELECT DISTINCT fire_id, time FROM cells) c)
    SELECT c.fire_id, c.time, CAST(count(*) FILTER (abs(i) * 5000 <= hh + 1e-9 AND abs(j) * 5000 <= hh + 1e-9) AS BIGINT) AS n_inside, round(sum(value) FILTER (abs(i) * 5000 <= hh + 1e-9 AND abs(j) * 5000 <= hh + 1e-9), 4) AS total FROM cells c JOIN d ON d.fire_id = c.fire_id AND d.time = c.time GROUP BY ALL""",
)
def _(spark, d):
    sections = perimeters(spark, d).where("slice_index % 2 = 0").select("fire_id", F.col("date").alias("time"), "ring")
    out = H.vase_extract(_event_cube(spark, d), sections)
    return out.groupBy("fire_id", "time").agg(F.count_if("inside").alias("n_inside"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "vase_mask_linear",
    "10.14",
    f"""WITH {_CELLS}, o AS (SELECT fire_id, date, h FROM per WHERE slice_index % 2 = 0), t AS (SELECT DISTINCT fire_id, time FROM cells),
    lo AS (SELECT t.fire_id, t.time, max(o.date) AS d, arg_max(o.h, o.date) AS h FROM t JOIN o ON o.fire_id = t.fire_id AND o.date <= t.time GROUP BY ALL), hi AS (SELECT t.fire_id, t.time, min(o.date) AS d, arg_min(o.h, o.date) AS h FROM t JOIN o ON o.fire_id = t.fire_id AND o.date > t.time GROUP BY ALL),
    r AS (SELECT lo.fire_id, lo.time, CASE WHEN hi.h IS NULL THEN lo.h ELSE lo.h + (hi.h - lo.h) * (date_diff('day', lo.d, lo.time) / CAST(date_diff('day', lo.d, hi.d) AS DOUBLE)) END AS hh FROM lo LEFT JOIN hi ON hi.fire_id = lo.fire_id AND hi.time = lo.time)
    SELECT c.fire_id, c.time, CAST(count(*) FILTER (abs(i) * 5000 <= hh + 1e-9 AND abs(j) * 5000 <= hh + 1e-9) AS BIGINT) AS n_inside FROM cells c JOIN r ON r.fire_id = c.fire_id AND r.time = c.time GROUP BY ALL""",
)
def _(spark, d):
    sections = perimeters(spark, d).where("slice_index % 2 = 0").select("fire_id", F.col("date").alias("time"), "ring")
    out = H.vase_mask(_event_cube(spark, d), sections, "linear")
    return out.groupBy("fire_id", "time").agg(F.count_if("inside").alias("n_inside"))


@query(
    "vase_panels",
    "10.15",
    f"""WITH {_PER}, n AS (SELECT *, lead(h) OVER w AS h2, lead(date) OVER w AS d2, max(h) OVER p AS hm, date_diff('day', min(date) OVER p, date) AS a, date_diff('day', min(date) OVER p, max(date) OVER p) AS s FROM per WINDOW w AS (PARTITION BY fire_id ORDER BY date), p AS (PARTITION BY fire_id))
    SELECT fire_id, date AS time, CAST(4 AS BIGINT) AS n, round(avg(0.5::DOUBLE), 8) AS x, round(abs(h - h2) / (2 * hm), 8) AS width, round(date_diff('day', date, d2) / CAST(s AS DOUBLE), 8) AS height FROM n WHERE h2 IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    sections = perimeters(spark, d).select("fire_id", F.col("date").alias("time"), "ring")
    p = H.vase_panels(sections, 4)
    out = p.groupBy("fire_id", "time").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("width").alias("width"), F.max("height").alias("height"))
    return rounded(out, "x", "width", "height", digits=8)


@query("exposure_zone_areas", "10.17")
def _(spark, d):
    p = perimeters(spark, d).select("fire_id", "date", "ring")
    return H.exposure_areas(p, [5000.0, 10000.0, 25000.0], cell=1000.0)


_GRID = {"x0": -126000.0, "dx": 3000.0, "nx": 20, "y0": 22000.0, "dy": 3000.0, "ny": 11}
_ZONE = f"""{_PER}, gx AS (SELECT ix, -126000.0::DOUBLE + ix * 3000 AS x FROM (SELECT unnest(generate_series(0, 19)) AS ix)), gy AS (SELECT iy, 22000.0::DOUBLE + iy * 3000 AS y FROM (SELECT unnest(generate_series(0, 10)) AS iy)),
ins AS (SELECT fire_id, date, ix, iy, 'grid_cells_inside_zone' AS m FROM per JOIN gx ON abs(x - cx) < h - 1e-9 JOIN gy ON abs(y - cy) < h - 1e-9),
res AS (SELECT fire_id, date, cx, cy, h FROM per WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.fire_id = per.fire_id AND ins.date = per.date)),
fb AS (SELECT fire_id, date, CASE WHEN ok THEN CAST(least(greatest(ceil(round((cx + 126000) / 3000, 9) - 0.5), 0), 19) AS INTEGER) END AS ix, CASE WHEN ok THEN CAST(least(greatest(ceil(round((cy - 22000) / 3000, 9) - 0.5), 0), 10) AS INTEGER) END AS iy, CASE WHEN ok THEN 'fallback_nearest_cell_to_zone' ELSE 'outside_grid' END AS m
  FROM (SELECT *, greatest(ceil(round((cx - h - 3000 + 126000) / 3000, 9)), 0) <= least(floor(round((cx + h + 3000 + 126000) / 3000, 9)), 19) AND greatest(ceil(round((cy - h - 3000 - 22000) / 3000, 9)), 0) <= least(floor(round((cy + h + 3000 - 22000) / 3000, 9)), 10) AS ok FROM res)),
zc AS (SELECT fire_id, date, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, m FROM ins UNION ALL SELECT * FROM fb)"""


@query("zonal_cells", "3.07", f"WITH {_ZONE} SELECT fire_id, date, ix, iy, m AS sample_method FROM zc")
def _(spark, d):
    return H.zonal_cells(perimeters(spark, d), ["fire_id", "date"], **_GRID)


@query(
    "zone_exposure",
    "10.18",
    f"""WITH {_ZONE}, li AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mo, CAST(l_suppkey % 20 AS INTEGER) AS ix, CAST(l_partkey % 11 AS INTEGER) AS iy, round(avg(l_quantity), 6) AS tmax, round(avg(l_tax) * 100, 6) AS wind FROM lineitem GROUP BY ALL)
    SELECT fire_id, date, array_to_string(list_sort(list(DISTINCT m)), ',') AS climate_sample_method, round(avg(tmax) + 1e-9, 6) AS tmax_mean, min(tmax) AS tmax_minimum, max(tmax) AS tmax_maximum, round(stddev_pop(tmax), 8) AS tmax_std, CAST(count(tmax) AS BIGINT) AS sample_cell_count,
      avg(tmax) IS NOT NULL AS climate_available, coalesce(avg(wind) > 0.1, false) AS wind_present FROM zc LEFT JOIN li ON li.mo = CAST(date_trunc('month', date) AS DATE) AND li.ix = zc.ix AND li.iy = zc.iy GROUP BY ALL""",
)
def _(spark, d):
    cells = H.zonal_cells(perimeters(spark, d), ["fire_id", "date"], **_GRID).withColumn("month", F.trunc("date", "month"))
    li = table(spark, d, "lineitem")
    grid = li.groupBy(
        F.trunc("l_shipdate", "month").alias("time"), (F.col("l_suppkey") % 20).cast("int").alias("ix"), (F.col("l_partkey") % 11).cast("int").alias("iy")
    ).agg(F.round(F.avg("l_quantity"), 6).alias("tmax"), F.round(F.avg("l_tax") * 100, 6).alias("wind"))
    out = H.zone_exposure_table(cells, grid, ["fire_id", "date"], ["tmax", "wind"], time="month", wind="wind")
    cols = ["fire_id", "date", "climate_sample_method", "tmax_mean", "tmax_minimum", "tmax_maximum", "tmax_std", "sample_cell_count", "climate_available", "wind_present"]
    return rounded(out.select(*cols).withColumn("tmax_mean", F.round(F.col("tmax_mean") + 1e-9, 6)), "tmax_std", digits=8)  # halves of the last digit go up


@query("event_hull_panel", "10.19 14.04")
def _(spark, d):
    metrics, failures = H.event_panel(perimeters(spark, d, 12), n_ring=24, n_theta=12)
    ok = metrics.select("fire_id", F.round("scale_km", 6).alias("scale_km"), F.lit(None).cast("string").alias("reason"))
    return ok.unionByName(failures.select("fire_id", F.lit(None).cast("double").alias("scale_km"), "reason"))
