"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import joins as J
from ..operators import neighbors
from ..operators import verbs as V
from .inputs import (
    CLIMATE,
    CUBE,
    FIRES,
    MULTI,
    PLACES,
    RINGS,
    SLICES,
    TRAITS,
    daily_growth,
    events_cube,
    multi_cube,
    places,
    rounded,
    shaped_slices,
    slices,
    table,
    traits,
)
from .registry import query


@query(
    "daily_with_event_attributes",
    "3.01",
    f"WITH {PLACES}, {RINGS} SELECT s.fire_id, s.timestamp, s.ring_area_km2, p.lon, p.lat FROM shaped s JOIN places p ON p.fire_id = s.fire_id",
)
def _(spark, d):
    out = J.join_events(shaped_slices(spark, d), places(spark, d), "fire_id")
    return out.select("fire_id", "timestamp", "ring_area_km2", "lon", "lat")


@query(
    "catalog_keys_filled",
    "3.02",
    f"""WITH {PLACES}, c AS (SELECT fire_id, 'climate:known-' || fire_id AS k FROM places WHERE c_custkey % 3 = 0)
    SELECT p.fire_id, coalesce(k, 'climate:' || substr(sha256('{{"component":"climate","identity":{{"fire_id":"' || p.fire_id || '"}},"inputs":{{"climate_source":"gridmet","geometry_cache_key":"geometry:unknown-' || p.fire_id || '","temporal_resolution":"daily","variables":["tmmx","vpd"]}},"versions":{{"climate":"c1"}}}}'), 1, 24)) AS climate_cache_key
    FROM places p LEFT JOIN c ON c.fire_id = p.fire_id""",
)
def _(spark, d):
    p = places(spark, d)
    catalog = p.where(F.col("c_custkey") % 3 == 0).select(
        "fire_id", F.concat(F.lit("climate:known-"), F.col("fire_id")).alias("climate_cache_key")
    )
    key = hashing.climate_key(
        F.col("fire_id"), F.concat(F.lit("geometry:unknown-"), F.col("fire_id")), "gridmet", ["vpd", "tmmx"], "daily", "c1"
    )
    return J.fill_from_catalog(p.select("fire_id"), catalog, "fire_id", "climate_cache_key", key)


_GRID = """g AS (SELECT CAST(l_shipdate AS DATE) AS time, -120.0::DOUBLE + 7 * (l_suppkey % 7) AS lon, 26.0::DOUBLE + 5 * (l_partkey % 5) AS lat, round(avg(l_quantity), 6) AS qty
    FROM lineitem GROUP BY ALL)"""


def _grid(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_shipdate").cast("date").alias("time"),
        (F.lit(-120.0) + 7 * (F.col("l_suppkey") % 7)).alias("lon"),
        (F.lit(26.0) + 5 * (F.col("l_partkey") % 5)).alias("lat"),
    ).agg(F.round(F.avg("l_quantity"), 6).alias("qty"))


@query(
    "nearest_cell_climate",
    "3.03",
    f"""WITH {PLACES}, {RINGS}, {_GRID}, tx AS (SELECT DISTINCT time FROM g), lx AS (SELECT DISTINCT lon FROM g), ly AS (SELECT DISTINCT lat FROM g),
    p AS (SELECT s.fire_id, s.timestamp AS day, p.lon, p.lat FROM shaped s JOIN places p ON p.fire_id = s.fire_id),
    dt AS (SELECT u.day, (SELECT time FROM tx ORDER BY abs(date_diff('day', time, u.day)), time LIMIT 1) AS nt FROM (SELECT DISTINCT day FROM p) u),
    dx AS (SELECT u.lon, (SELECT lx.lon FROM lx ORDER BY abs(lx.lon - u.lon), lx.lon LIMIT 1) AS nx FROM (SELECT DISTINCT lon FROM p) u),
    dy AS (SELECT u.lat, (SELECT ly.lat FROM ly ORDER BY abs(ly.lat - u.lat), ly.lat LIMIT 1) AS ny FROM (SELECT DISTINCT lat FROM p) u)
    SELECT p.fire_id, p.day, g.qty FROM p JOIN dt ON dt.day = p.day JOIN dx ON dx.lon = p.lon JOIN dy ON dy.lat = p.lat
    LEFT JOIN g ON g.time = dt.nt AND g.lon = dx.nx AND g.lat = dy.ny""",
)
def _(spark, d):
    pts = shaped_slices(spark, d).join(places(spark, d).select("fire_id", "lon", "lat"), "fire_id")
    pts = pts.select("fire_id", F.col("timestamp").alias("time"), "lon", "lat")
    out = J.nearest_cell_join(pts, _grid(spark, d), ["qty"])
    return out.select("fire_id", F.col("time").alias("day"), "qty")


@query(
    "as_of_perimeter",
    "3.04",
    f"""WITH {PLACES}, {RINGS}, days AS (SELECT CAST(o_custkey AS VARCHAR) AS fire_id, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT d.fire_id, d.day, s.timestamp AS state_date, s.cumulative_area_km2 FROM days d ASOF JOIN shaped s ON s.fire_id = d.fire_id AND d.day >= s.timestamp""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("fire_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("day"))
    days = li.join(o, "o_orderkey").select("fire_id", "day").distinct()
    return J.as_of_join(days, shaped_slices(spark, d), key="fire_id", day="day", date="timestamp", values=["cumulative_area_km2"])


def _spread(step: int, first: int):
    """Days moved apart, so that the two axes differ and no row is left out."""
    start = F.lit("2024-01-01").cast("date")
    return F.date_add(start, F.datediff("time", start) * step + first)


def _like(spark, d):
    e = events_cube(spark, d)
    return e.select(_spread(3, 1).alias("time"), (F.col("y") * 0.5 + 0.25).alias("y"), (F.col("x") + 0.5).alias("x")).distinct()


def _even(spark, d):
    return events_cube(spark, d).select(_spread(2, 0).alias("time"), "y", "x", "value")


_ALIGN = f"""WITH {CUBE}, src AS (SELECT CAST(DATE '2024-01-01' + 2 * CAST(date_diff('day', DATE '2024-01-01', time) AS INTEGER) AS DATE) AS time, CAST(y_idx AS DOUBLE) AS y, CAST(x_idx AS DOUBLE) AS x, value FROM cube),
    likes AS (SELECT DISTINCT CAST(DATE '2024-01-01' + 3 * CAST(date_diff('day', DATE '2024-01-01', time) AS INTEGER) + 1 AS DATE) AS time, y_idx * 0.5::DOUBLE + 0.25 AS y, x_idx + 0.5::DOUBLE AS x FROM cube),
    hull AS (SELECT min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM src), tx AS (SELECT DISTINCT time FROM src)"""


@query(
    "aligned_cube_nearest",
    "3.05",
    f"""{_ALIGN}, ay AS (SELECT DISTINCT y FROM src), axx AS (SELECT DISTINCT x FROM src),
    ny AS (SELECT l.y, (SELECT ay.y FROM ay ORDER BY abs(ay.y - l.y), ay.y LIMIT 1) AS s FROM (SELECT DISTINCT y FROM likes) l, hull WHERE l.y BETWEEN y0 AND y1),
    nx AS (SELECT l.x, (SELECT axx.x FROM axx ORDER BY abs(axx.x - l.x), axx.x LIMIT 1) AS s FROM (SELECT DISTINCT x FROM likes) l, hull WHERE l.x BETWEEN x0 AND x1),
    nt AS (SELECT l.time, (SELECT max(tx.time) FROM tx WHERE tx.time <= l.time) AS s FROM (SELECT DISTINCT time FROM likes) l)
    SELECT l.time, l.y, l.x, round(src.value, 6) AS value FROM likes l LEFT JOIN ny ON ny.y = l.y LEFT JOIN nx ON nx.x = l.x LEFT JOIN nt ON nt.time = l.time AND date_diff('day', nt.s, l.time) <= 1
    LEFT JOIN src ON src.time = nt.s AND src.y = ny.s AND src.x = nx.s""",
)
def _(spark, d):
    return rounded(J.align_cube(_even(spark, d), _like(spark, d), temporal="pad", tolerance_days=1), "value")


@query(
    "aligned_cube_linear",
    "3.05",
    f"""{_ALIGN}, nt AS (SELECT l.time, (SELECT tx.time FROM tx ORDER BY abs(date_diff('day', tx.time, l.time)), tx.time LIMIT 1) AS s FROM (SELECT DISTINCT time FROM likes) l),
    t4 AS (SELECT l.*, nt.s, floor(l.y) + dy AS sy, floor(l.x) + dx AS sx, CASE dy WHEN 0 THEN 1 - (l.y - floor(l.y)) ELSE l.y - floor(l.y) END * CASE dx WHEN 0 THEN 1 - (l.x - floor(l.x)) ELSE l.x - floor(l.x) END AS w
      FROM likes l JOIN nt ON nt.time = l.time CROSS JOIN (VALUES (0), (1)) a(dy) CROSS JOIN (VALUES (0), (1)) b(dx) CROSS JOIN hull WHERE l.y BETWEEN y0 AND y1 AND l.x BETWEEN x0 AND x1),
    g AS (SELECT t4.time, t4.y, t4.x, sum(src.value * w) AS v, sum(w) FILTER (src.value IS NOT NULL) AS ww FROM t4 JOIN src ON src.time = t4.s AND src.y = t4.sy AND src.x = t4.sx WHERE w > 0 GROUP BY ALL)
    SELECT l.time, l.y, l.x, round(CASE WHEN abs(ww - 1) < 1e-9 THEN v END, 8) AS value FROM likes l LEFT JOIN g ON g.time = l.time AND g.y = l.y AND g.x = l.x""",
)
def _(spark, d):
    return rounded(J.align_cube(_even(spark, d), _like(spark, d), spatial="linear"), "value", digits=8)


@query(
    "rasterized_observations",
    "3.06",
    f"""WITH {CUBE}, ob AS (SELECT CAST(ts AS DATE) AS date, (user_id // 10) * 1.1::DOUBLE AS y, (user_id % 10) * 1.05::DOUBLE + 0.2 AS x, value FROM events),
    ay AS (SELECT DISTINCT CAST(y_idx AS DOUBLE) AS c FROM cube), axx AS (SELECT DISTINCT CAST(x_idx AS DOUBLE) AS c FROM cube), atm AS (SELECT DISTINCT time AS c FROM cube),
    py AS (SELECT y, (SELECT c FROM ay ORDER BY abs(c - y), c LIMIT 1) AS s FROM (SELECT DISTINCT y FROM ob)),
    px AS (SELECT x, (SELECT c FROM axx ORDER BY abs(c - x), c LIMIT 1) AS s FROM (SELECT DISTINCT x FROM ob)),
    pt AS (SELECT date, (SELECT c FROM atm ORDER BY abs(date_diff('day', c, date)), c LIMIT 1) AS s FROM (SELECT DISTINCT date FROM ob)),
    r AS (SELECT pt.s AS time, py.s AS y, px.s AS x, sum(value) AS v FROM ob JOIN py USING (y) JOIN px USING (x) JOIN pt USING (date) GROUP BY ALL),
    f AS (SELECT DISTINCT time, CAST(y_idx AS DOUBLE) AS y, CAST(x_idx AS DOUBLE) AS x FROM cube)
    SELECT f.time, f.y, f.x, round(r.v, 5) AS value FROM f LEFT JOIN r ON r.time = f.time AND r.y = f.y AND r.x = f.x""",
)
def _(spark, d):
    e = table(spark, d, "events")
    obs = e.select(
        F.col("ts").cast("date").alias("date"),
        (F.floor(F.col("user_id") / 10) * F.lit(1.1)).alias("y"),
        (F.col("user_id") % 10 * F.lit(1.05) + 0.2).alias("x"),
        "value",
    )
    return rounded(J.rasterize_observations(obs, events_cube(spark, d)), "value", digits=5)


_SPACE = f"""{CUBE}, nn AS (SELECT max(x_idx) + 1 AS nx FROM cube), pl AS (SELECT DISTINCT y_idx * nx + x_idx AS space, y_idx, x_idx, CAST(y_idx AS DOUBLE) AS y, CAST(x_idx AS DOUBLE) AS x FROM cube, nn),
    km AS (SELECT a.space AS source, b.space AS target, CASE WHEN abs(a.y) <= 90 AND abs(b.y) <= 90 THEN
      2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) ELSE sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) END AS distance FROM pl a, pl b)"""


@query(
    "reference_pairs",
    "3.08",
    f"""WITH {_SPACE}, c AS (SELECT ((max(y_idx) + 1) // 2) * max(nx) + (max(x_idx) + 1) // 2 AS r FROM pl, nn) SELECT source, target, round(distance, 5) AS distance FROM km, c WHERE target = r""",
)
def _(spark, d):
    return rounded(J.spatial_pairs(J.places_of(events_cube(spark, d)), "reference"), "distance", digits=5)


@query(
    "radius_pairs",
    "3.08",
    f"WITH {_SPACE} SELECT source, target, round(distance, 5) AS distance FROM km WHERE source < target AND distance <= 250",
)
def _(spark, d):
    return rounded(J.spatial_pairs(J.places_of(events_cube(spark, d)), "neighbors", radius=250), "distance", digits=5)


@query(
    "radius_pairs_k_nearest",
    "3.08",
    f"""WITH {_SPACE}, o AS (SELECT * FROM km WHERE source <> target AND distance <= 250), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(distance, 9), target) AS rn FROM o)
    SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target, round(distance, 5) AS distance FROM r WHERE rn <= 3""",
)
def _(spark, d):
    return rounded(J.spatial_pairs(J.places_of(events_cube(spark, d)), "neighbors", radius=250, k=3), "distance", digits=5)


@query(
    "k_nearest_places",
    "3.08",
    f"""WITH {PLACES}, p AS (SELECT c_custkey AS space, lon + (c_custkey % 13) * 0.01 + c_custkey * 0.00001 AS x, lat + (c_custkey % 17) * 0.013 AS y FROM places),
    v AS (SELECT *, cos(radians(y)) * cos(radians(x)) AS a, cos(radians(y)) * sin(radians(x)) AS b, sin(radians(y)) AS c FROM p),
    o AS (SELECT s.space AS source, t.space AS target, round(sqrt(pow(s.a - t.a, 2) + pow(s.b - t.b, 2) + pow(s.c - t.c, 2)), 9) AS dd,
      2 * 6371.0088 * asin(sqrt(pow(sin(radians(t.y - s.y) / 2), 2) + cos(radians(s.y)) * cos(radians(t.y)) * pow(sin(radians(t.x - s.x) / 2), 2))) AS distance FROM v s JOIN v t ON s.space <> t.space),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dd, target) AS rn FROM o)
    SELECT least(source, target) AS source, greatest(source, target) AS target, round(min(distance), 4) AS distance FROM r WHERE rn <= 2 GROUP BY ALL""",
)
def _(spark, d):
    p = places(spark, d).select(
        F.col("c_custkey").alias("space"),
        (F.col("lon") + F.col("c_custkey") % 13 * 0.01 + F.col("c_custkey") * 0.00001).alias("x"),
        (F.col("lat") + F.col("c_custkey") % 17 * 0.013).alias("y"),
    )
    return rounded(J.spatial_pairs(p, "neighbors", k=2), "distance", digits=4)


@query(
    "centre_reference_series",
    "3.09",
    f"""WITH {CUBE}, ref AS (SELECT k.time, k.value AS ref FROM cube k, (SELECT (max(y_idx) + 1) // 2 AS cy, (max(x_idx) + 1) // 2 AS cx FROM cube) c WHERE k.y_idx = cy AND k.x_idx = cx)
    SELECT cube.time, y_idx, x_idx, value, ref FROM cube LEFT JOIN ref ON ref.time = cube.time""",
)
def _(spark, d):
    return V.with_center_reference(events_cube(spark, d)).select("time", "y_idx", "x_idx", "value", "ref")


@query(
    "series_outer_alignment",
    "3.11",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS time, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS time, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1)
    SELECT time, orders, qty FROM a FULL JOIN b USING (time)""",
)
def _(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("time")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("time")).agg(F.round(F.sum("l_quantity"), 4).alias("qty"))
    return J.align_join(a, b, how="outer")


@query(
    "series_exact_alignment",
    "3.11",
    f"""WITH {MULTI}, s AS (SELECT variable, time, avg(value) AS value FROM multi GROUP BY ALL) SELECT a.time, round(a.value, 5) AS left_value, round(b.value, 5) AS right_value
    FROM s a JOIN s b USING (time) WHERE a.variable = 'click' AND b.variable = 'view'""",
)
def _(spark, d):
    m = multi_cube(spark, d).groupBy("variable", "time").agg(F.avg("value").alias("value"))
    a = m.where("variable = 'click'").select("time", F.col("value").alias("left_value"))
    b = m.where("variable = 'view'").select("time", F.col("value").alias("right_value"))
    return rounded(J.align_join(a, b, how="exact"), "left_value", "right_value", digits=5)


#: All dimensions of the embeddings, and the same in SQL: ``v`` is the vector, the distance has nine digits.
AXES = [f"e{i:02d}" for i in range(64)]
POINTS = "pt AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def feature_points(spark, d):
    """id, label and the whole vector ``v``."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def by_axis(points):
    """The vector's coordinates as columns AXES, for operators that work on columns."""
    return points.select(*[c for c in points.columns if c != "v"], *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(AXES)])


@query(
    "feature_space_neighbors",
    "3.12",
    f"""WITH {POINTS}, o AS (SELECT s.id AS query_id, t.id AS neighbor_id, round(list_distance(s.v, t.v), 9) AS dd FROM pt s JOIN pt t ON s.id <> t.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dd, neighbor_id) AS rank FROM o) SELECT query_id, neighbor_id, dd AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def _(spark, d):
    p = feature_points(spark, d)
    return neighbors.knn_join(p, p, 5, "v")


@query(
    "coverage_classes",
    "3.13",
    f"""WITH {SLICES}, c AS (SELECT fire_id, bool_and(climate_available AND year <= 1999) AS a, bool_or(year > 1999) AS s FROM slices GROUP BY 1)
    SELECT fire_id, CASE WHEN a THEN 'complete' WHEN s THEN 'unsupported' ELSE 'incomplete' END AS coverage FROM c""",
)
def _(spark, d):
    return J.coverage_sets(slices(spark, d), "fire_id", F.col("climate_available"), F.col("year") <= 1999)


@query(
    "semi_and_anti_selection",
    "3.13",
    f"""WITH {TRAITS} SELECT fire_id, region FROM traits WHERE fire_id IN (SELECT fire_id FROM daily WHERE ring_area_km2 > 40) AND fire_id NOT IN (SELECT fire_id FROM daily WHERE year(timestamp) = 2001)""",
)
def _(spark, d):
    g = daily_growth(spark, d)
    t = traits(spark, d).select("fire_id", "region")
    return t.join(g.where("ring_area_km2 > 40"), "fire_id", "left_semi").join(g.where("year(timestamp) = 2001"), "fire_id", "left_anti")


@query(
    "region_month_anomaly",
    "3.14",
    f"""WITH {FIRES}, r AS (SELECT s.fire_id, s.slice_index, t.region, CAST(month(s.timestamp) AS INTEGER) AS month, s.vpd_kpa FROM slices s JOIN traits t ON t.fire_id = s.fire_id WHERE climate_available),
    m AS (SELECT region, month, quantile_cont(vpd_kpa, 0.5) AS med FROM r GROUP BY ALL) SELECT fire_id, slice_index, round(vpd_kpa - med, 6) AS vpd_anomaly FROM r JOIN m USING (region, month)""",
)
def _(spark, d):
    s = slices(spark, d).where("climate_available").select("fire_id", "slice_index", F.month("timestamp").alias("month"), *CLIMATE)
    s = s.join(traits(spark, d).select("fire_id", "region"), "fire_id")
    return rounded(J.group_median_anomaly(s, "vpd_kpa", ["region", "month"], "vpd_anomaly").select("fire_id", "slice_index", "vpd_anomaly"), "vpd_anomaly")
