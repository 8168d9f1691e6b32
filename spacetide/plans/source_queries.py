"""Reading, tiling, sampling and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import verbs as V
from ..session import cut_lineage, scratch_path
from ..sources import cube as S
from ..sources import tables as T
from .inputs import CUBE, MULTI, PLACES, TRAITS, daily_growth, events_cube, multi_cube, places, rounded, table, traits
from .registry import query


def _grid(spark, d):
    """lineitem as raw grid rows: time, lat, lon, value."""
    return table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        (F.col("l_suppkey") % 25).cast("double").alias("lat"),
        (F.lit(-125.0) + F.col("l_partkey") % 50).alias("lon"),
        F.col("l_quantity").alias("value"),
    )


@query(
    "cube_box_read",
    "1.01",
    """SELECT CAST(l_shipdate AS DATE) AS time, CAST(l_suppkey % 25 AS DOUBLE) AS lat, CAST(-125 + l_partkey % 50 AS DOUBLE) AS lon, l_quantity AS value
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-12-31' AND l_suppkey % 25 BETWEEN 2 AND 8 AND -125 + l_partkey % 50 BETWEEN -120 AND -100""",
)
def _(spark, d):
    box = S.aoi_box(geojson='{"type":"Polygon","coordinates":[[[-120,2],[-100,2],[-100,8],[-120,8],[-120,2]]]}')
    out = S.select_cube(_grid(spark, d), box=box, start="1996-03-01", end="1996-12-31")
    return out.withColumn("time", F.col("time").cast("date"))


@query(
    "landed_cube_round_trip",
    "1.01",
    f"""WITH {MULTI} SELECT variable, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM multi
    WHERE variable IN ('click', 'view') AND time BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND y_idx BETWEEN 0 AND 7 GROUP BY 1""",
)
def _(spark, d):
    root = scratch_path(spark, "cube")
    land = multi_cube(spark, d).select("variable", "time", F.col("y").alias("lat"), F.col("x").alias("lon"), "value")
    S.write_cube(land, root)
    back = S.read_cube(spark, root, variables=["click", "view"], start="2024-01-05", end="2024-01-20", bbox=(0, 0, 9, 7))
    return back.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "aoi_bounds_from_geojson",
    "1.02",
    f"""WITH {PLACES} SELECT fire_id, round(lon - 0.5, 6) AS min_lon, lat AS min_lat, round(lon + 0.25, 6) AS max_lon, lat + 1 AS max_lat FROM places""",
)
def _(spark, d):
    p = places(spark, d)
    corner = lambda dx, dy: F.array(F.round(F.col("lon") + dx, 6), F.col("lat") + dy)
    ring = F.array(corner(-0.5, 0), corner(0.25, 0), corner(0.25, 1), corner(-0.5, 1), corner(-0.5, 0))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return S.aoi_bounds(p.withColumn("shape", shape), "fire_id", "shape")


@query(
    "normalized_dims",
    "1.03",
    f"WITH {PLACES} SELECT fire_id, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon, lat FROM places",
)
def _(spark, d):
    raw = places(spark, d).select("fire_id", F.col("lon").alias("Longitude"), F.col("lat").alias("latitude"))
    return rounded(S.normalize_dims(raw, wrap=True).select("fire_id", "lon", "lat"), "lon")


@query(
    "monthly_resample",
    "1.04",
    """WITH s AS (SELECT CAST(l_suppkey AS BIGINT) AS unit, CAST(date_trunc('month', l_shipdate) AS DATE) AS time, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
    r AS (SELECT CAST(unnest(generate_series((SELECT min(time) FROM s), (SELECT max(time) FROM s), INTERVAL 1 MONTH)) AS DATE) AS time),
    u AS (SELECT DISTINCT unit FROM s)
    SELECT u.unit, r.time, round(s.value, 5) AS value FROM u CROSS JOIN r LEFT JOIN s ON s.unit = u.unit AND s.time = r.time""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_shipdate").cast("date").alias("time"), F.col("l_quantity").alias("value")
    )
    return rounded(S.resample_time(li, "month", keys=["unit"]), "value", digits=5)


_CODES = {"click": "tmmx", "view": "tmmn", "purchase": "vs"}


def _coded(spark, d):
    code = F.create_map(*[F.lit(v) for kv in _CODES.items() for v in kv])
    return multi_cube(spark, d).withColumn("variable", code[F.col("variable")]).where(F.col("variable").isNotNull())


@query(
    "semantic_minimum_temperature",
    "1.05",
    f"WITH {MULTI} SELECT time, y_idx, x_idx, 'tmmn' AS variable, value FROM multi WHERE variable = 'view'",
)
def _(spark, d):
    return S.semantic_cube(_coded(spark, d), "temperature_min", "gridmet").select("time", "y_idx", "x_idx", "variable", "value")


@query(
    "temperature_anomaly_baseline",
    "1.06",
    f"""WITH {CUBE}, m AS (SELECT y_idx, x_idx, avg(value) AS m FROM cube WHERE time BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' GROUP BY ALL)
    SELECT time, y_idx, x_idx, round(value - m, 8) AS value FROM cube LEFT JOIN m USING (y_idx, x_idx)""",
)
def _(spark, d):
    c = events_cube(spark, d)
    base = c.where(F.col("time").between("2024-01-01", "2024-01-10"))
    return rounded(V.anomaly_against(c, base).select("time", "y_idx", "x_idx", "value"), "value", digits=8)


@query(
    "year_chunk_counts",
    "1.07",
    """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS t FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-06-15' AND DATE '2000-03-01'),
    c AS (SELECT CAST(1995 + 2 * ((year(t) - 1995) // 2) AS INTEGER) AS y FROM r)
    SELECT greatest(DATE '1995-06-15', make_date(y, 1, 1)) AS chunk_start, least(DATE '2000-03-01', make_date(y + 1, 12, 31)) AS chunk_end, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""",
)
def _(spark, d):
    return S.year_chunks(_grid(spark, d), "1995-06-15", "2000-03-01", years=2).groupBy("chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tile_counts",
    "1.08",
    """WITH g AS (SELECT l_shipdate AS t, CAST(l_suppkey % 25 AS DOUBLE) AS lat, CAST(-125 + l_partkey % 50 AS DOUBLE) AS lon FROM lineitem)
    SELECT CAST(least(floor((lon + 120) / 7), 4) AS INTEGER) AS tile_x, CAST(least(floor(lat / 5), 3) AS INTEGER) AS tile_y, CAST(date_trunc('year', t) AS DATE) AS tile_t,
      CAST(count(*) AS BIGINT) AS n FROM g WHERE lon BETWEEN -120 AND -88 AND lat BETWEEN 0 AND 20 GROUP BY ALL""",
)
def _(spark, d):
    t = S.assign_tiles(_grid(spark, d), box=(-120, 0, -88, 20), dlon=7, dlat=5)
    return t.groupBy("tile_x", "tile_y", "tile_t").agg(F.count(F.lit(1)).alias("n"))


@query("combined_tiles", "1.09", f"WITH {CUBE} SELECT time, y_idx, x_idx, value FROM cube")
def _(spark, d):
    c = events_cube(spark, d).select("time", "y_idx", "x_idx", "value")
    early = c.where(F.col("time") <= "2024-01-11")
    late = c.where(F.col("time") >= "2024-01-11")  # one shared day
    return S.combine_tiles(early, late)


@query(
    "cube_around_events",
    "1.10",
    f"""WITH {PLACES}, e AS (SELECT fire_id AS event_id, lon, lat, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS t0 FROM places),
    g AS (SELECT CAST(l_shipdate AS DATE) AS time, CAST(l_suppkey % 25 + 25 AS DOUBLE) AS lat, CAST(-125 + l_partkey % 50 AS DOUBLE) AS lon, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL)
    SELECT e.event_id, g.time, g.lon, g.lat, g.value FROM e JOIN g ON abs(g.lon - e.lon) <= 1.5 AND abs(g.lat - e.lat) <= 1.5 AND g.time BETWEEN e.t0 - 2 AND e.t0 + 5 + 2""",
)
def _(spark, d):
    p = places(spark, d)
    start = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))
    ev = p.select(F.col("fire_id").alias("event_id"), "lon", "lat", start.alias("t0"), F.date_add(start, 5).alias("t1"))
    g = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_shipdate").cast("date").alias("time"),
            (F.col("l_suppkey") % 25 + 25).cast("double").alias("lat"),
            (F.lit(-125.0) + F.col("l_partkey") % 50).alias("lon"),
        )
        .agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    )
    return S.cube_for_events(ev, g, buffer_days=2, reach=1.5)


@query(
    "data_presence",
    "1.11",
    f"WITH {MULTI} SELECT variable, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(value) AS BIGINT) AS n_present, count(value) > 0 AS usable FROM multi GROUP BY 1",
)
def _(spark, d):
    return S.data_probe(S.require_data(multi_cube(spark, d)), "variable")


@query(
    "bbox_centers",
    "1.12",
    f"""WITH {PLACES} SELECT fire_id, round(lon - 0.25, 6) AS center_lon, lat + 0.75 AS center_lat, CAST(greatest(100000, floor(1.5 * 111000)) AS DOUBLE) AS edge_size FROM places""",
)
def _(spark, d):
    p = places(spark, d).select(
        "fire_id",
        (F.col("lon") - 0.75).alias("min_lon"),
        (F.col("lon") + 0.25).alias("max_lon"),
        F.col("lat").alias("min_lat"),
        (F.col("lat") + 1.5).alias("max_lat"),
    )
    return rounded(S.bbox_center(p, 100000).select("fire_id", "center_lon", "center_lat", "edge_size"), "center_lon")


@query(
    "harmonised_event_table",
    "1.13",
    "SELECT o_custkey AS event_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS final_area_km2, o_orderstatus AS status FROM orders",
)
def _(spark, d):
    raw = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("observed_at"),
        F.col("o_totalprice").alias("tot_ar_km2"),
        F.col("o_orderstatus").alias("status"),
    )
    return T.harmonise(raw)


@query(
    "projected_traits",
    "1.14",
    f"""WITH {TRAITS} SELECT fire_id, year, region, total_area_km2, duration_hours / 24 AS duration_days, round(total_area_km2 / duration_hours * 24, 6) AS peak_growth_km2_per_day FROM traits""",
)
def _(spark, d):
    t = traits(spark, d).withColumn("peak_growth_km2_per_hour", F.col("total_area_km2") / F.col("duration_hours"))
    return rounded(T.project_slices(t), "peak_growth_km2_per_day")


@query(
    "converted_units",
    "1.15",
    f"""WITH {MULTI}, c AS (SELECT time, y_idx, x_idx, CASE variable WHEN 'click' THEN 'tmmx' WHEN 'view' THEN 'tmmn' WHEN 'purchase' THEN 'vs' END AS variable, value + 280 AS value FROM multi)
    SELECT time, y_idx, x_idx, variable, round(CASE WHEN variable IN ('tmmx', 'tmmn') THEN value - 273.15 ELSE value END, 6) AS value FROM c WHERE variable IS NOT NULL""",
)
def _(spark, d):
    kelvin = _coded(spark, d).withColumn("value", F.col("value") + 280)
    return rounded(S.guarded_kelvin(kelvin).select("time", "y_idx", "x_idx", "variable", "value"), "value")


@query(
    "resolved_column",
    "1.16",
    "SELECT CAST(l_shipdate AS DATE) AS time, l_orderkey, l_linenumber, l_quantity AS vs FROM lineitem",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("time"), "l_orderkey", "l_linenumber",
        F.col("l_discount").alias("a"),
        F.col("l_quantity").alias("q", metadata={"standard_name": "wind_speed"}),
    )
    name = S.resolve_variable(li, "vs", coordinates=("time", "l_orderkey", "l_linenumber"))
    return li.select("time", "l_orderkey", "l_linenumber", F.col(name).alias("vs"))


@query(
    "partitioned_table_write",
    "1.17",
    f"WITH {TRAITS} SELECT region, 'v_1' AS processing_version, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT year) AS BIGINT) AS years FROM traits GROUP BY 1",
)
def _(spark, d):
    t = traits(spark, d).withColumns(
        {"spatial_bucket": C.spatial_bucket("lon", "lat", 5.0), "processing_version": F.lit("v/1")}
    )
    path = T.write_table(t, scratch_path(spark, "lake"), "traits")
    back = spark.read.parquet(path)
    return back.groupBy("region", "processing_version").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("year").alias("years"))


@query(
    "good_slices",
    "1.18",
    f"WITH {CUBE} SELECT time, y_idx, x_idx, value FROM cube WHERE time IN (SELECT time FROM cube WHERE y_idx = 0 AND x_idx = 3)",
)
def _(spark, d):
    probe = (F.col("y_idx") == 0) & (F.col("x_idx") == 3)
    return S.drop_bad_slices(events_cube(spark, d), probe).select("time", "y_idx", "x_idx", "value")


@query(
    "provenance_columns",
    "1.19",
    f"""WITH {CUBE} SELECT time, y_idx, x_idx, value, 'events' AS source, false AS is_synthetic, 'daily' AS freq, '2024-01-01' AS requested_start, '2024-01-30' AS requested_end, NULL::VARCHAR AS backend_error FROM cube""",
)
def _(spark, d):
    c = events_cube(spark, d).select("time", "y_idx", "x_idx", "value")
    return S.attach_provenance(c, source="events", freq="daily", start="2024-01-01", end="2024-01-30")


@query("file_checksums", "1.20")
def _(spark, d):
    inv = cut_lineage(T.file_inventory(spark, d, "*.parquet"), "inventory")
    wrong = F.when(F.col("file").startswith("region"), F.lit("0")).otherwise(F.col("sha256"))
    expected = inv.select("file", wrong.alias("sha256")).where("file <> 'part.parquet'")
    return T.verify_checksums(inv, expected).join(inv.select("file", "kind", "size_bytes"), "file")


_STRATA = "CASE WHEN total_area_km2 < 100 THEN 'small' WHEN total_area_km2 < 300 THEN 'medium' ELSE 'large' END"


@query(
    "stratified_event_sample",
    "1.21",
    f"""WITH {TRAITS}, m AS (SELECT fire_id, {_STRATA} AS size_bin, md5(fire_id || '|7') AS h FROM traits),
    r AS (SELECT *, row_number() OVER (PARTITION BY size_bin ORDER BY h, fire_id) AS rn FROM m),
    p AS (SELECT (100 // (SELECT count(DISTINCT size_bin) FROM m)) AS per)
    SELECT fire_id, size_bin FROM r, p ORDER BY CASE WHEN rn <= per THEN 0 ELSE 1 END, h, fire_id LIMIT 100""",
)
def _(spark, d):
    t = traits(spark, d)
    a = F.col("total_area_km2")
    t = t.withColumn("size_bin", F.when(a < 100, "small").when(a < 300, "medium").otherwise("large"))
    return T.stratified_sample(t.select("fire_id", "size_bin"), "fire_id", "size_bin", 100, seed=7)


@query(
    "uniform_event_sample",
    "1.22",
    f"WITH {TRAITS} SELECT fire_id, region FROM traits ORDER BY md5(fire_id || '|3'), fire_id LIMIT 120",
)
def _(spark, d):
    return T.sample_rows(traits(spark, d).select("fire_id", "region"), "fire_id", 120, seed=3)
