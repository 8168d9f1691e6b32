"""Filters, masks, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geodesy, hashing, ranking
from ..operators import verbs as V
from ..sources import tables as T
from .inputs import (
    CUBE,
    DENSE,
    MULTI,
    PLACES,
    REGION_CASE,
    SLICES,
    TRAITS,
    daily_growth,
    events_cube,
    multi_cube,
    places,
    rounded,
    slices,
    table,
    traits,
)
from .registry import query


@query(
    "anomaly_variance_chain",
    "2.01 2.02 14.01",
    f"""WITH {CUBE}, a AS (SELECT *, value - avg(value) OVER (PARTITION BY y_idx, x_idx) AS v FROM cube)
    SELECT y_idx, x_idx, round(var_pop(v) * 2, 6) AS value FROM a GROUP BY ALL""",
)
def _(spark, d):
    def scale(df, by):
        return df.withColumn("value", F.col("value") * by)

    chain = V.pipe(events_cube(spark, d)) | V.anomaly | V.variance | V.apply(scale, by=2)
    return rounded(chain.unwrap(), "value")


@query(
    "month_filter_summer",
    "2.03",
    """SELECT CAST(l_shipdate AS DATE) AS time, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS qty
    FROM lineitem WHERE month(l_shipdate) IN (6, 7, 8) GROUP BY 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("time"), "l_quantity")
    kept = V.month_filter(li, [6, 7, 8])
    return kept.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query(
    "threshold_masks",
    "2.04 2.07",
    f"""WITH {DENSE} SELECT time, y_idx, x_idx, coalesce(value > 12, false) AS gt, coalesce(value >= 12, false) AS ge,
      coalesce(value < 12, false) AS lt, coalesce(value <= 12, false) AS le,
      coalesce(value BETWEEN 5 AND 15, false) AS suitable FROM grid""",
)
def _(spark, d):
    from ..model import index_cube

    g = index_cube(events_cube(spark, d))
    mask = {n: V.threshold_mask("value", 12.0, op).alias(n) for n, op in zip(["gt", "ge", "lt", "le"], [">", ">=", "<", "<="])}
    return g.select("time", "y_idx", "x_idx", *mask.values(), V.suitability("value", 5, 15).alias("suitable"))


@query(
    "cohort_selection",
    "2.05",
    f"""WITH {TRAITS} SELECT fire_id, region, total_area_km2 FROM traits
    WHERE region IN ('west', 'central') AND year = 1995 AND total_area_km2 > 100""",
)
def _(spark, d):
    cohort = V.select_cohort(traits(spark, d), region={"west", "central"}, year=1995, total_area_km2=lambda c: c > 100)
    return cohort.select("fire_id", "region", "total_area_km2")


@query(
    "temporally_supported_event",
    "2.06",
    """WITH s AS (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, min(CAST(o_orderdate AS DATE)) AS t0,
      max(CAST(o_orderdate AS DATE)) AS t1, min(o_orderkey) AS f FROM orders GROUP BY 1)
    SELECT o_custkey AS event_id, CAST(n_days AS BIGINT) AS n_days, t0, t1 FROM s
    WHERE n_days >= 5 AND t0 - 14 >= DATE '1995-01-10' AND t1 + 14 <= DATE '2001-07-01' ORDER BY f, o_custkey LIMIT 1""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey"
    )
    return V.temporal_support(
        o, start="1995-01-10", end="2001-07-01", buffer_days=14, min_days=5, key="event_id", day="date", order="o_orderkey"
    )


@query(
    "vegetation_index",
    "2.08",
    f"""WITH {MULTI}, p AS (SELECT time, y_idx, x_idx, max(value) FILTER (variable = 'purchase') AS nir,
      max(value) FILTER (variable = 'click') AS red FROM multi WHERE variable IN ('purchase', 'click') GROUP BY ALL)
    SELECT time, y_idx, x_idx, round(CAST(CAST((nir - red) / nullif(nir + red + 1e-6, 0) AS FLOAT) AS DOUBLE), 5) AS value FROM p""",
)
def _(spark, d):
    out = V.ndvi(multi_cube(spark, d), "purchase", "click", eps=1e-6)
    return out.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(
    "stacked_space",
    "2.09",
    f"""WITH {CUBE}, n AS (SELECT max(x_idx) + 1 AS nx FROM cube), s AS (SELECT time, y_idx * nx + x_idx AS space, value FROM cube, n)
    SELECT time, space, CAST(space // 10 AS BIGINT) AS y_idx, CAST(space % 10 AS BIGINT) AS x_idx, value FROM s""",
)
def _(spark, d):
    stacked = V.stack_space(events_cube(spark, d)).select("time", "space", "value")
    return V.unstack_space(stacked, 10)


@query(
    "cropped_to_finite",
    "2.10",
    f"""WITH {CUBE}, m AS (SELECT time, y_idx, x_idx, CASE WHEN y_idx BETWEEN 1 AND 2 AND x_idx > 3 THEN value END AS value FROM cube),
    b AS (SELECT min(y_idx) y0, max(y_idx) y1, min(x_idx) x0, max(x_idx) x1 FROM m WHERE value IS NOT NULL)
    SELECT time, y_idx, x_idx, value FROM m, b WHERE y_idx BETWEEN y0 AND y1 AND x_idx BETWEEN x0 AND x1""",
)
def _(spark, d):
    c = events_cube(spark, d)
    seen = F.col("y_idx").between(1, 2) & (F.col("x_idx") > 3)
    # at the smallest scale the grid has two rows only
    masked = c.withColumn("value", F.when(seen, F.col("value")))
    return V.crop_to_finite(masked).select("time", "y_idx", "x_idx", "value")


@query(
    "every_third_step",
    "2.11",
    f"""WITH {DENSE} SELECT k.time, k.y_idx, k.x_idx, k.value FROM cube k JOIN axis a ON a.time = k.time WHERE a.t_idx % 3 = 0""",
)
def _(spark, d):
    return V.stride(events_cube(spark, d), 3).select("time", "y_idx", "x_idx", "value")


@query(
    "region_and_bucket",
    "2.12 2.13",
    f"""WITH {PLACES} SELECT fire_id, {REGION_CASE} AS region,
      CASE WHEN lon < -112 THEN 'west' WHEN lon < -96 THEN 'intermountain' WHEN lon < -84 THEN 'central' ELSE 'east' END AS atlas_region,
      CASE WHEN floor(lat / 2) >= 0 THEN 'n' ELSE 's' END || lpad(CAST(CAST(abs(floor(lat / 2)) AS BIGINT) AS VARCHAR), 3, '0') || '_' ||
      CASE WHEN floor(lon / 2) >= 0 THEN 'e' ELSE 'w' END || lpad(CAST(CAST(abs(floor(lon / 2)) AS BIGINT) AS VARCHAR), 4, '0') AS bucket
    FROM places""",
)
def _(spark, d):
    return places(spark, d).select(
        "fire_id",
        C.region_of("lon", "lat").alias("region"),
        C.region_of("lon", "lat", bounded=False).alias("atlas_region"),
        C.spatial_bucket("lon", "lat", 2.0).alias("bucket"),
    )


@query(
    "fixed_bins",
    "2.14",
    f"""WITH {SLICES}, r AS (SELECT *, round(slice_index / greatest(n_obs - 1, 1), 9) AS rel FROM slices)
    SELECT fire_id, timestamp,
      CASE WHEN month(timestamp) IN (12,1,2) THEN 'winter' WHEN month(timestamp) IN (3,4,5) THEN 'spring'
           WHEN month(timestamp) IN (6,7,8) THEN 'summer' ELSE 'fall' END AS season,
      CASE WHEN n_obs <= 1 THEN '1' WHEN n_obs <= 3 THEN '2-3' WHEN n_obs <= 7 THEN '4-7' ELSE '8+' END AS duration,
      CASE WHEN rel <= 1.0/3 THEN 'early' WHEN rel <= 2.0/3 THEN 'middle' ELSE 'late' END AS part,
      CAST(CASE WHEN year + 5 BETWEEN 1999 AND 2004 THEN 0 WHEN year + 5 <= 2008 THEN 1 END AS INTEGER) AS block FROM r""",
)
def _(spark, d):
    s = slices(spark, d)
    rel = F.round(F.col("slice_index") / F.greatest(F.col("n_obs") - 1, F.lit(1)), 9)
    return s.select(
        "fire_id",
        "timestamp",
        C.season(F.month("timestamp")).alias("season"),
        C.duration_bin("n_obs").alias("duration"),
        C.time_bin(rel).alias("part"),
        C.year_block(F.col("year") + 5).alias("block"),
    )


@query(
    "area_quantile_bins",
    "2.15",
    f"""WITH {TRAITS}, q AS (SELECT list_distinct([round(v, 9) FOR v IN quantile_cont(total_area_km2, [0.25, 0.5, 0.75])]) AS e FROM traits)
    SELECT fire_id, CAST(len(list_filter(e, lambda v: v < total_area_km2)) AS INTEGER) AS bin FROM traits, q""",
)
def _(spark, d):
    return ranking.qcut(traits(spark, d), "total_area_km2", 4, "bin").select("fire_id", "bin")


@query(
    "attribute_pattern_evidence",
    "2.16",
    """WITH u AS (SELECT p_partkey, 'p_type' AS col, p_type AS val FROM part UNION ALL
      SELECT p_partkey, 'p_name', p_name FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part),
    h AS (SELECT * FROM u WHERE regexp_matches(val, 'econ|ring', 'i'))
    SELECT col AS column_name, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n_events,
      array_to_string(list_sort(list(DISTINCT val))[1:20], ',') AS evidence FROM h GROUP BY 1""",
)
def _(spark, d):
    p = table(spark, d, "part")
    return T.attribute_evidence(p, "p_partkey", pattern="econ|ring")


@query(
    "attribute_pattern_events",
    "2.16",
    "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'prom', 'i') OR regexp_matches(p_name, 'prom', 'i') OR regexp_matches(p_brand, 'prom', 'i')",
)
def _(spark, d):
    return T.attribute_matches(table(spark, d, "part"), "p_partkey", pattern="prom").select("p_partkey")


@query(
    "selected_variable",
    "2.17",
    f"WITH {MULTI} SELECT time, y_idx, x_idx, value FROM multi WHERE variable = 'view'",
)
def _(spark, d):
    return V.select_variable(multi_cube(spark, d), "view").select("time", "y_idx", "x_idx", "value")


@query(
    "climate_flags",
    "2.18",
    f"""WITH {SLICES} SELECT fire_id, slice_index, climate_available, wind_present,
      CASE WHEN NOT climate_available THEN 'outside_gridmet_coverage_or_missing_value' END AS climate_failure_reason FROM slices""",
)
def _(spark, d):
    return T.climate_flags(slices(spark, d), ["maximum_temperature_c", "minimum_temperature_c", "vpd_kpa", "wind_speed_m_s"]).select(
        "fire_id", "slice_index", "climate_available", "wind_present", "climate_failure_reason"
    )


# --- sorts and limits --------------------------------------------------------


@query(
    "largest_events",
    "6.01",
    f"WITH {TRAITS} SELECT fire_id, region, year, total_area_km2 FROM traits ORDER BY total_area_km2 DESC, fire_id LIMIT 20",
)
def _(spark, d):
    t = traits(spark, d).select("fire_id", "region", "year", "total_area_km2")
    return t.orderBy(F.desc("total_area_km2"), "fire_id").limit(20)


@query(
    "longest_events",
    "6.01",
    f"WITH {TRAITS} SELECT fire_id, region, round(duration_hours / 24, 6) AS duration_days FROM traits ORDER BY duration_hours DESC, fire_id LIMIT 20",
)
def _(spark, d):
    t = traits(spark, d).orderBy(F.desc("duration_hours"), "fire_id").limit(20)
    return t.select("fire_id", "region", F.round(F.col("duration_hours") / 24, 6).alias("duration_days"))


@query(
    "event_panel_selection",
    "6.06",
    f"""WITH {TRAITS}, s AS (SELECT fire_id, min(timestamp) AS t0, max(timestamp) AS t1 FROM daily GROUP BY 1)
    SELECT fire_id, t0 FROM s WHERE date_diff('day', t0, t1) + 1 BETWEEN 100 AND 2000 ORDER BY t0, fire_id LIMIT 50""",
)
def _(spark, d):
    spans = daily_growth(spark, d).groupBy("fire_id").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    return T.panel_selection(spans, min_days=100, max_days=2000, max_events=50).select("fire_id", "t0")


@query(
    "longest_event_in_box",
    "6.07",
    f"""WITH {TRAITS}, s AS (SELECT d.fire_id, min(timestamp) AS t0, max(timestamp) AS t1, any_value(p.lon) AS lon, any_value(p.lat) AS lat,
      any_value(c_mktsegment) AS cause FROM daily d JOIN places p USING (fire_id) GROUP BY 1),
    b AS (SELECT *, date_diff('day', t0, t1) + 1 AS days, (cause ILIKE '%auto%') AS hit FROM s
      WHERE lon + 0.5 >= -113 AND lon - 0.5 <= -90 AND lat + 0.5 >= 30 AND lat - 0.5 <= 40)
    SELECT fire_id, t0, CAST(days AS INTEGER) AS days FROM b WHERE (hit OR NOT (SELECT bool_or(hit) FROM b)) AND days BETWEEN 10 AND 2300
    ORDER BY days DESC, t0, fire_id LIMIT 1""",
)
def _(spark, d):
    spans = daily_growth(spark, d).groupBy("fire_id").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    p = places(spark, d).select(
        "fire_id",
        F.col("c_mktsegment").alias("cause"),
        (F.col("lon") - 0.5).alias("xmin"),
        (F.col("lon") + 0.5).alias("xmax"),
        (F.col("lat") - 0.5).alias("ymin"),
        (F.col("lat") + 0.5).alias("ymax"),
    )
    ev = spans.join(p, "fire_id").withColumn("days", F.datediff("t1", "t0") + 1)
    return T.longest_in_box(ev, box=(-113, 30, -90, 40), pattern="auto", min_days=10, max_days=2300).select("fire_id", "t0", "days")


# --- set operations ----------------------------------------------------------


@query(
    "union_of_sources",
    "7.01",
    """SELECT 'order' AS source, o_custkey AS key, o_totalprice AS amount, NULL::INTEGER AS nation FROM orders
    UNION ALL SELECT 'customer', c_custkey, NULL, c_nationkey FROM customer""",
)
def _(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"))
    b = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "shared_times",
    "7.02",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS time FROM lineitem INTERSECT SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders",
)
def _(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("time"))
    return a.intersect(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("time")))


@query(
    "ids_without_events",
    "7.03",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").subtract(o)


@query(
    "consecutive_duplicates_dropped",
    "7.04",
    """WITH s AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_orderpriority FROM orders),
    l AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY date, o_orderkey) AS prev FROM s)
    SELECT o_custkey, date, o_orderkey, o_orderpriority FROM l WHERE o_orderpriority IS DISTINCT FROM prev""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", "o_orderpriority")
    return T.drop_consecutive_duplicates(o.dropDuplicates(), "o_custkey", ["date", "o_orderkey"], "o_orderpriority")


# --- scalar functions --------------------------------------------------------


@query(
    "date_functions",
    "8.01",
    f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, user_id FROM events),
    s AS (SELECT event_id, day, CAST(month(day) AS INTEGER) AS m, CAST(year(day) AS INTEGER) AS y, CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS since, user_id FROM e)
    SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN day END AS parsed, m, y, since,
      CAST(CASE WHEN user_id % 3 = 0 THEN (user_id % 10) * 365 WHEN user_id % 3 = 1 THEN user_id % 10 END AS INTEGER) AS tolerance FROM s""",
)
def _(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("user_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("not a date"))
    digit = (F.col("user_id") % 10).cast("string")
    span = (
        F.when(F.col("user_id") % 3 == 0, F.concat(digit, F.lit("Y")))
        .when(F.col("user_id") % 3 == 1, F.concat(digit, F.lit("D")))
        .otherwise(F.lit("soon"))
    )
    return e.select(
        "event_id",
        C.midnight(text).alias("parsed"),
        F.month("ts").alias("m"),
        F.year("ts").alias("y"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("since"),
        C.span_days(span).alias("tolerance"),
    )


@query(
    "median_time_step",
    "8.01",
    f"""WITH {CUBE}, t AS (SELECT DISTINCT time FROM cube), g AS (SELECT date_diff('day', time, lead(time) OVER (ORDER BY time)) AS s FROM t)
    SELECT CAST(median(s) AS DOUBLE) AS step_days, CAST(greatest(1, round(30 / median(s))) AS INTEGER) AS periods FROM g""",
)
def _(spark, d):
    c = events_cube(spark, d)
    return V.median_step_days(c).withColumn("periods", F.greatest(F.lit(1), F.round(30 / F.col("step_days")).cast("int")))


@query(
    "string_functions",
    "8.02",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
      'y=' || CAST(p_size AS VARCHAR) || ',x=' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS place,
      p_brand || '__' || p_type AS pair FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        C.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"),
        C.place_label(F.col("p_size").cast("double"), "p_retailprice").alias("place"),
        C.pair_label("p_brand", "p_type").alias("pair"),
    )


@query(
    "comma_lists",
    "8.02",
    "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY 1",
)
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(C.comma_list("p_type").alias("types"))


@query(
    "math_functions",
    "8.03",
    f"""WITH {TRAITS} SELECT fire_id, round(log10(greatest(total_area_km2, 1e-9)), 6) AS log_area, round(ln(1 + greatest(total_area_km2, 0)), 6) AS log1p_area,
      round(sqrt(total_area_km2 / pi()), 6) AS radius, round((duration_hours / 24) / greatest(2 * sqrt(total_area_km2 / pi()), 0.1), 6) AS slenderness,
      round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(-105 - lon) / 2), 2))), 6) AS km
    FROM traits""",
)
def _(spark, d):
    t = traits(spark, d)
    out = t.select(
        "fire_id",
        C.log10_clipped("total_area_km2").alias("log_area"),
        C.log1p_clipped("total_area_km2").alias("log1p_area"),
        C.equivalent_radius("total_area_km2").alias("radius"),
        C.slenderness(F.col("duration_hours") / 24, "total_area_km2").alias("slenderness"),
        C.place_distance(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-105.0)).alias("km"),
    )
    return rounded(out, "log_area", "log1p_area", "radius", "slenderness", "km")


@query(
    "albers_projection",
    "10.05",
    f"""WITH {PLACES}, k AS (SELECT 1 / 298.257222101 AS f), e AS (SELECT 2 * f - f * f AS e2, sqrt(2 * f - f * f) AS e FROM k),
    qq AS (SELECT e2, e, radians(29.5) p1, radians(45.5) p2, radians(23) p0 FROM e),
    c0 AS (SELECT *, cos(p1) / sqrt(1 - e2 * sin(p1) * sin(p1)) AS m1, cos(p2) / sqrt(1 - e2 * sin(p2) * sin(p2)) AS m2,
      (1 - e2) * (sin(p1) / (1 - e2 * sin(p1) * sin(p1)) - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e)) AS q1,
      (1 - e2) * (sin(p2) / (1 - e2 * sin(p2) * sin(p2)) - ln((1 - e * sin(p2)) / (1 + e * sin(p2))) / (2 * e)) AS q2,
      (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) * sin(p0)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM qq),
    c1 AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM c0), c2 AS (SELECT *, m1 * m1 + n * q1 AS cc FROM c1),
    pt AS (SELECT p.fire_id, p.lon, sin(radians(p.lat)) AS s, c2.* FROM places p, c2),
    pq AS (SELECT *, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q FROM pt),
    pr AS (SELECT *, 6378137.0 * sqrt(cc - n * q) / n AS rho, 6378137.0 * sqrt(cc - n * q0) / n AS rho0, n * radians(lon + 96) AS th FROM pq)
    SELECT fire_id, round(rho * sin(th), 3) AS x_m, round(rho0 - rho * cos(th), 3) AS y_m, true AS round_trip FROM pr""",
)
def _(spark, d):
    p = places(spark, d)
    x, y = geodesy.albers_xy(F.col("lon"), F.col("lat"))
    xy = p.withColumns({"x": x, "y": y})
    lon, lat = geodesy.albers_lonlat(F.col("x"), F.col("y"))
    same = (F.abs(lon - F.col("lon")) < 1e-7) & (F.abs(lat - F.col("lat")) < 1e-7)
    return xy.select("fire_id", F.round("x", 3).alias("x_m"), F.round("y", 3).alias("y_m"), same.alias("round_trip"))


@query(
    "content_hashes",
    "8.06",
    """SELECT c_custkey, substr(sha256('{"id":' || CAST(c_custkey AS VARCHAR) || ',"name":"' || c_name || '","tags":["a","b"]}'), 1, 16) AS short_hash,
      'geometry:' || substr(sha256('{"component":"geometry","identity":{"fire_id":"' || CAST(c_custkey AS VARCHAR) || '"},"inputs":{"method":"canonical_fire_time_geometry","source_geometry_hash":"' || c_name || '"},"versions":{"geometry":"g1"}}'), 1, 24) AS component
    FROM customer""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        hashing.content_hash({"name": F.col("c_name"), "id": F.col("c_custkey"), "tags": ["a", "b"]}).alias("short_hash"),
        hashing.geometry_key(F.col("c_custkey").cast("string"), F.col("c_name"), "g1").alias("component"),
    )
