"""Reducers, signatures, reports and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import quantile_table, quantiles
from ..operators import activity as A
from ..operators import population as P
from ..operators import verbs as V
from .inputs import (
    CLIMATE,
    CUBE,
    FIRES,
    MULTI,
    RINGS,
    SLICES,
    TRAITS,
    daily_growth,
    events_cube,
    multi_cube,
    rounded,
    shaped_slices,
    slices,
    table,
    traits,
)
from .join_queries import POINTS, feature_points
from .registry import query


@query(
    "mean_over_time",
    "4.01",
    f"WITH {CUBE} SELECT y_idx, x_idx, round(avg(value), 8) AS value, 0 AS time_idx FROM cube GROUP BY ALL",
)
def _(spark, d):
    return rounded(V.mean(events_cube(spark, d), "time", keep_dim=True), "value", digits=8)


@query("mean_over_space", "4.01", f"WITH {CUBE} SELECT time, round(avg(value), 8) AS value FROM cube GROUP BY ALL")
def _(spark, d):
    return rounded(V.mean(events_cube(spark, d), ["y", "x"]), "value", digits=8)


@query("variance_over_time", "4.02", f"WITH {CUBE} SELECT y_idx, x_idx, round(var_pop(value), 6) AS value FROM cube GROUP BY ALL")
def _(spark, d):
    return rounded(V.variance(events_cube(spark, d)), "value")


@query(
    "tilewise_mean_variance",
    "4.03",
    f"""WITH {CUBE} SELECT y_idx, x_idx, CAST(count(value) AS BIGINT) AS n, round(avg(value), 8) AS mean, round(var_pop(value), 6) AS variance FROM cube GROUP BY ALL""",
)
def _(spark, d):
    c = events_cube(spark, d).withColumn("tile", F.weekofyear("time"))
    v = F.col("value")
    tiles = c.groupBy("y_idx", "x_idx", "tile").agg(F.count(v).alias("n"), F.sum(v).alias("s"), (F.var_pop(v) * F.count(v)).alias("m2"))
    tiles = tiles.withColumn("m", F.col("s") / F.col("n"))
    grand = F.sum("s") / F.sum("n")
    # within-tile plus between-tile squares
    ss = F.sum("m2") + F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand
    out = tiles.groupBy("y_idx", "x_idx").agg(F.sum("n").alias("n"), grand.alias("mean"), F.greatest(ss / F.sum("n"), F.lit(0.0)).alias("variance"))
    return rounded(rounded(out, "variance"), "mean", digits=8)


@query(
    "display_statistics",
    "4.04",
    f"WITH {CUBE} SELECT time, round(avg(value), 8) AS mean, round(var_samp(value), 6) AS variance, round(quantile_cont(value, 0.5), 8) AS median FROM cube GROUP BY ALL",
)
def _(spark, d):
    out = V.reduce_cube(events_cube(spark, d), ["y", "x"], F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    med = quantile_table(events_cube(spark, d), "value", [0.5], ["time"]).withColumnRenamed("q0", "median")
    return rounded(rounded(out.join(med, "time"), "variance"), "mean", "median", digits=8)


@query(
    "middle_slices",
    "4.05",
    f"WITH {CUBE}, n AS (SELECT (max(y_idx) + 1) // 2 AS cy FROM cube) SELECT time, y_idx, x_idx, value FROM cube, n WHERE y_idx = cy",
)
def _(spark, d):
    c = events_cube(spark, d)
    mid = c.agg(F.floor((F.max("y_idx") + 1) / 2)).scalar()
    return c.where(F.col("y_idx") == mid).select("time", "y_idx", "x_idx", "value")


@query(
    "value_histogram",
    "4.05",
    f"""WITH {CUBE}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM cube) SELECT CAST(least(floor(round((value - lo) / (hi - lo) * 20, 9)), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM cube, b GROUP BY 1""",
)
def _(spark, d):
    c = events_cube(spark, d)
    span = c.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("b")).scalar()
    b = c.withColumn("_b", span)
    at = F.floor(F.round((F.col("value") - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo")) * 20, 9))
    return b.groupBy(F.least(at, F.lit(19)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "spatial_band_per_time",
    "4.05",
    f"WITH {CUBE} SELECT time, round(quantile_cont(value, 0.1), 8) AS q10, round(quantile_cont(value, 0.5), 8) AS q50, round(quantile_cont(value, 0.9), 8) AS q90 FROM cube GROUP BY 1",
)
def _(spark, d):
    q = quantile_table(events_cube(spark, d), "value", [0.1, 0.5, 0.9], ["time"])
    return rounded(q.toDF("time", "q10", "q50", "q90"), "q10", "q50", "q90", digits=8)


_SIG = f"{MULTI}, sig AS (SELECT 'row' || CAST(y_idx % 5 AS VARCHAR) AS unit, time, variable, quantile_cont(value, 0.5) AS value FROM multi GROUP BY ALL)"


def _unit():
    return F.concat(F.lit("row"), (F.col("y_idx") % 5).cast("string"))


def _signature(spark, d):
    return V.unit_signature(multi_cube(spark, d), _unit())


@query("block_signatures", "4.06", f"WITH {_SIG} SELECT unit, time, variable, round(value, 8) AS value FROM sig")
def _(spark, d):
    return rounded(_signature(spark, d), "value", digits=8)


@query(
    "block_coordinates",
    "4.06",
    f"""WITH {MULTI}, u AS (SELECT DISTINCT 'row' || CAST(y_idx % 5 AS VARCHAR) AS unit, CAST(y_idx AS DOUBLE) AS y FROM multi), w AS (SELECT DISTINCT 'row' || CAST(y_idx % 5 AS VARCHAR) AS unit, CAST(x_idx AS DOUBLE) AS x FROM multi)
    SELECT unit, round(avg(DISTINCT y), 6) AS y_center, min(y) AS y_min, max(y) AS y_max, round(avg(DISTINCT x), 6) AS x_center, min(x) AS x_min, max(x) AS x_max FROM u JOIN w USING (unit) GROUP BY 1""",
)
def _(spark, d):
    return rounded(V.unit_coordinates(multi_cube(spark, d), _unit()), "y_center", "x_center")


_METRICS = "round(CASE WHEN sqrt(var_pop(a.value) * var_pop(b.value)) > 1e-12 THEN covar_pop(a.value, b.value) / sqrt(var_pop(a.value) * var_pop(b.value)) END, 6) AS pearson_r, round(avg(a.value - b.value), 6) AS mean_difference, round(sqrt(avg(pow(a.value - b.value, 2))), 6) AS rmse, CAST(count(*) AS BIGINT) AS n"


@query("compared_signatures", "4.07", f"WITH {_SIG} SELECT a.variable, {_METRICS} FROM sig a JOIN sig b USING (time, variable) WHERE a.unit = 'row0' AND b.unit = 'row1' GROUP BY 1")
def _(spark, d):
    s = _signature(spark, d)
    out = V.compare_signatures(s.where("unit = 'row0'"), s.where("unit = 'row1'"))
    return rounded(out, "pearson_r", "mean_difference", "rmse")


@query(
    "compared_blocks",
    "4.08",
    f"WITH {_SIG} SELECT a.unit AS left_block, b.unit AS right_block, a.unit || '__' || b.unit AS pair, a.variable, {_METRICS} FROM sig a JOIN sig b USING (time, variable) WHERE a.unit < b.unit GROUP BY ALL",
)
def _(spark, d):
    s = _signature(spark, d)
    parts = V.collect_units(s.where("unit < 'row2'"), s.where("unit >= 'row2'"))
    return rounded(V.compare_units(parts), "pearson_r", "mean_difference", "rmse")


@query(
    "coarsened_mean",
    "4.09",
    f"""WITH {CUBE}, n AS (SELECT max(y_idx) + 1 AS ny, max(x_idx) + 1 AS nx FROM cube)
    SELECT time, y_idx // 2 AS y_idx, x_idx // 3 AS x_idx, round(avg(value), 7) AS value FROM cube, n WHERE y_idx // 2 < ny // 2 AND x_idx // 3 < nx // 3 GROUP BY ALL""",
)
def _(spark, d):
    return rounded(V.coarsen_mean(events_cube(spark, d), 2, 3), "value", digits=7)


@query(
    "event_aligned_quantiles",
    "4.12",
    """WITH r AS (SELECT CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS offset_days, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT offset_days, list(v ORDER BY v) AS l, count(*) AS n FROM r GROUP BY 1)
    SELECT offset_days, CAST(n AS BIGINT) AS count, l[CAST(round_even((n - 1) * 0.1::DOUBLE, 0) AS INTEGER) + 1] AS q10, round((l[CAST(floor((n - 1) / 2.0) AS INTEGER) + 1] + l[CAST(ceil((n - 1) / 2.0) AS INTEGER) + 1]) / 2, 6) AS q50,
      l[CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS INTEGER) + 1] AS q90 FROM s""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").select(F.datediff("l_shipdate", "o_orderdate").alias("offset_days"), F.col("l_extendedprice").alias("v"))
    return rounded(P.event_aligned_quantiles(rows, "v", "offset_days"), "q50")


@query(
    "population_report",
    "4.13",
    f"""WITH {TRAITS}, g AS (SELECT region, year, CAST(grouping(region, year) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n_fires, CAST(count(DISTINCT y) AS BIGINT) AS n_years, min(y) AS min_year, max(y) AS max_year, round(sum(total_area_km2), 4) AS total_area_km2, round(avg(total_area_km2), 6) AS mean_area_km2, max(total_area_km2) AS max_area_km2,
      round(avg(duration_hours / 24), 6) AS mean_duration_days, max(duration_hours / 24) AS max_duration_days, round(quantile_cont(total_area_km2, 0.5), 6) AS med, round(quantile_cont(duration_hours / 24, 0.5), 6) AS medd FROM (SELECT *, year AS y FROM traits) GROUP BY GROUPING SETS ((), (year), (region), (region, year)))
    SELECT region, year, level, n_fires, n_years, min_year, max_year, total_area_km2, mean_area_km2, max_area_km2, mean_duration_days, max_duration_days, CASE WHEN level IN (1, 3) THEN med END AS median_area_km2, CASE WHEN level IN (1, 3) THEN medd END AS median_duration_days FROM g""",
)
def _(spark, d):
    out = P.population_report(traits(spark, d))
    return rounded(rounded(out, "mean_area_km2", "mean_duration_days", "median_area_km2", "median_duration_days"), "total_area_km2", digits=4)


@query(
    "population_status_counts",
    "4.13",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def _(spark, d):
    o = table(spark, d, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "population_quantiles",
    "4.13",
    f"""WITH {TRAITS}, m AS (SELECT 'total_area_km2' AS metric, total_area_km2 AS v FROM traits UNION ALL SELECT 'duration_days', duration_hours / 24 FROM traits)
    SELECT metric, round(quantile_cont(v, 0.01), 8) AS p01, round(quantile_cont(v, 0.1), 8) AS p10, round(quantile_cont(v, 0.5), 8) AS p50, round(quantile_cont(v, 0.9), 8) AS p90, round(quantile_cont(v, 0.99), 8) AS p99 FROM m GROUP BY 1""",
)
def _(spark, d):
    t = traits(spark, d).withColumn("duration_days", F.col("duration_hours") / 24)
    return rounded(P.quantile_report(t, ["total_area_km2", "duration_days"]), "p01", "p10", "p50", "p90", "p99", digits=8)


@query(
    "event_spans",
    "4.14",
    'SELECT CAST(o_custkey AS VARCHAR) AS fire_id, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE)) AS "end", CAST(date_diff(\'day\', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1 AS INTEGER) AS duration_days, CAST(count(*) AS BIGINT) AS n_rows FROM orders GROUP BY 1',
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("fire_id"), F.col("o_orderdate").cast("date").alias("timestamp"))
    return P.event_summary(o)


@query(
    "cohort_medoids",
    "4.15",
    f"""WITH {TRAITS}, s AS (SELECT a.region, a.fire_id, round(sum(sqrt(pow(a.total_area_km2 - b.total_area_km2, 2) + pow(a.duration_hours - b.duration_hours, 2))), 6) AS total_distance FROM traits a JOIN traits b ON a.region = b.region GROUP BY ALL)
    SELECT region, arg_min(fire_id, (total_distance, fire_id)) AS fire_id, round(min(total_distance), 4) AS total_distance FROM s GROUP BY 1""",
)
def _(spark, d):
    return rounded(P.medoid(traits(spark, d), ["total_area_km2", "duration_hours"], by="region"), "total_distance", digits=4)


@query(
    "cross_validation_summary",
    "4.19",
    """WITH f AS (SELECT l_returnflag AS model, CAST(l_suppkey % 10 AS INTEGER) AS fold, round(avg(l_discount) * 10, 8) AS r2 FROM lineitem GROUP BY ALL)
    SELECT model, round(avg(r2), 6) AS mean_r2, round(quantile_cont(r2, 0.025), 6) AS low, round(quantile_cont(r2, 0.975), 6) AS high, CAST(count(*) AS BIGINT) AS n_folds FROM f GROUP BY 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    f = li.groupBy(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 10).cast("int").alias("fold")).agg(F.round(F.avg("l_discount") * 10, 8).alias("r2"))
    return rounded(P.fold_summary(f, ["model"]), "mean_r2", "low", "high")


@query(
    "metric_summary",
    "4.20",
    f"""WITH {TRAITS}, m AS (SELECT 'total_area_km2' AS metric, total_area_km2 AS v FROM traits UNION ALL SELECT 'duration_hours', duration_hours FROM traits)
    SELECT metric, CAST(count(*) AS BIGINT) AS n, min(v) AS minimum, round(avg(v), 6) AS mean, max(v) AS maximum, round(quantile_cont(v, 0.5), 6) AS median FROM m GROUP BY 1""",
)
def _(spark, d):
    return rounded(P.metric_summary(traits(spark, d), ["total_area_km2", "duration_hours"]), "mean", "median")


@query(
    "category_fingerprints",
    "4.21",
    f"""WITH {TRAITS}, m AS (SELECT region, 'total_area_km2' AS trait, total_area_km2 AS v FROM traits UNION ALL SELECT region, 'duration_hours', duration_hours FROM traits),
    q AS (SELECT region, trait, quantile_cont(v, 0.5) AS median FROM m GROUP BY ALL)
    SELECT region, trait, round(median, 6) AS median, round(CASE WHEN stddev_pop(median) OVER w > 1e-12 THEN (median - avg(median) OVER w) / stddev_pop(median) OVER w END, 6) AS z FROM q WINDOW w AS (PARTITION BY trait)""",
)
def _(spark, d):
    return rounded(P.category_fingerprints(traits(spark, d), "region", ["total_area_km2", "duration_hours"]), "median", "z")


@query(
    "environmental_roles",
    "4.22",
    f"""WITH {SLICES}, l AS (SELECT fire_id, timestamp, 'vpd_kpa' AS variable, vpd_kpa AS v FROM slices UNION ALL SELECT fire_id, timestamp, 'wind_speed_m_s', wind_speed_m_s FROM slices),
    p AS (SELECT *, lag(v) OVER (PARTITION BY fire_id, variable ORDER BY timestamp) AS pv FROM l), b AS (SELECT *, CASE WHEN pv IS NOT NULL THEN v END AS x, CASE WHEN v IS NOT NULL THEN pv END AS y FROM p)
    SELECT fire_id, variable, round(stddev_pop(v - pv), 9) AS step_sd, round(CASE WHEN count(*) >= 3 AND sqrt(var_pop(x) * var_pop(y)) > 1e-12 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END, 9) AS lag1_autocorr, round(stddev_pop(v), 9) AS within_sd
    FROM b GROUP BY ALL HAVING count(*) >= 2""",
)
def _(spark, d):
    return rounded(A.environmental_roles(slices(spark, d), ["vpd_kpa", "wind_speed_m_s"]), "step_sd", "lag1_autocorr", "within_sd", digits=9)


@query(
    "state_transition_matrix",
    "4.23",
    f"""WITH {RINGS}, s AS (SELECT fire_id, timestamp, CASE WHEN ring_area_km2 > 30 THEN 'major' WHEN ring_area_km2 > 10 THEN 'active' ELSE 'low' END AS st FROM rings),
    t AS (SELECT st AS from_state, lead(st, 1, 'terminal observed record') OVER (PARTITION BY fire_id ORDER BY timestamp) AS to_state FROM s), c AS (SELECT from_state, to_state, count(*) AS n FROM t GROUP BY ALL)
    SELECT from_state, to_state, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS probability FROM c""",
)
def _(spark, d):
    g = F.col("ring_area_km2")
    s = shaped_slices(spark, d).withColumn("developmental_state", F.when(g > 30, "major").when(g > 10, "active").otherwise("low"))
    return rounded(A.state_transitions(s.withColumnRenamed("slice_index", "observation_index")), "probability")


@query(
    "climate_availability",
    "4.25",
    f"""WITH {SLICES}, n AS (SELECT count(*) AS n, count(maximum_temperature_c) AS a, count(vpd_kpa) AS b FROM slices)
    SELECT 'maximum_temperature_c' AS variable, CAST(a AS BIGINT) AS present, CAST(n - a AS BIGINT) AS missing FROM n UNION ALL SELECT 'vpd_kpa', b, n - b FROM n""",
)
def _(spark, d):
    return P.availability(slices(spark, d), ["maximum_temperature_c", "vpd_kpa"])


@query(
    "availability_by_region",
    "4.25",
    f"""WITH {FIRES} SELECT t.region, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT s.fire_id) AS BIGINT) AS n_fires, round(avg(CAST(climate_available AS INTEGER)), 6) AS availability_rate FROM slices s JOIN traits t ON t.fire_id = s.fire_id GROUP BY 1""",
)
def _(spark, d):
    s = slices(spark, d).join(traits(spark, d).select("fire_id", "region"), "fire_id")
    return rounded(P.availability(s, CLIMATE, zone="region"), "availability_rate")


@query(
    "pixel_area",
    "4.26",
    f"WITH {TRAITS} SELECT round(quantile_cont(ring_area_km2 / pixels, 0.5), 6) AS pixel_area_km2 FROM daily WHERE pixels > 0",
)
def _(spark, d):
    return rounded(P.pixel_area_estimate(daily_growth(spark, d), "ring_area_km2", "pixels"), "pixel_area_km2")


# --- picks -------------------------------------------------------------------


@query(
    "extreme_pair_of_similar_size",
    "6.04",
    f"""WITH {TRAITS}, e AS (SELECT list_distinct([round(v, 9) FOR v IN quantile_cont(total_area_km2, [i / 40.0 FOR i IN generate_series(0, 40)])]) AS e FROM traits),
    b AS (SELECT fire_id, duration_hours, len(list_filter(list_sort(e)[2:-2], lambda v: v < round(total_area_km2, 9))) AS bin FROM traits, e),
    p AS (SELECT bin, arg_min(fire_id, (duration_hours, fire_id)) AS low_id, arg_max(fire_id, (duration_hours, fire_id)) AS high_id, round(max(duration_hours) - min(duration_hours), 9) AS gap FROM b GROUP BY 1 HAVING count(*) >= 20)
    SELECT CAST(bin AS INTEGER) AS bin, low_id, high_id, gap FROM p ORDER BY gap DESC, bin LIMIT 1""",
)
def _(spark, d):
    return P.extreme_pairs_in_bins(traits(spark, d), "total_area_km2", "duration_hours")


@query(
    "class_shape_examples",
    "6.05",
    f"""WITH {POINTS}, e AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pt), m AS (SELECT label, i, quantile_cont(x, 0.5) AS m FROM e GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT label, arg_min(id, (round(list_distance(v, c), 9), id)) AS fire_id FROM pt JOIN c USING (label) GROUP BY 1""",
)
def _(spark, d):
    return P.class_examples(feature_points(spark, d).withColumnRenamed("id", "fire_id"), "label", "v")


@query(
    "transect_examples",
    "6.05",
    f"""WITH {POINTS}, s AS (SELECT id, list_sum(v) AS a FROM pt), q AS (SELECT unnest(generate_series(0, 6)) AS i), t AS (SELECT CAST(i AS INTEGER) AS target_order, (SELECT quantile_cont(a, [0.04, 0.19333333333333333, 0.3466666666666667, 0.5, 0.6533333333333333, 0.8066666666666666, 0.96]) FROM s)[i + 1] AS target FROM q)
    SELECT target_order, arg_min(id, (round(abs(a - target), 9), id)) AS fire_id FROM s, t GROUP BY 1""",
)
def _(spark, d):
    # along the diagonal of the space: the sum of all coordinates
    p = feature_points(spark, d).select(F.col("id").alias("fire_id"), F.aggregate("v", F.lit(0.0), lambda t, x: t + x).alias("along"))
    targets = quantiles(p, "along", [0.04 + i * 0.92 / 6 for i in range(7)])
    return P.nearest_to_targets(p, "along", targets)


@query(
    "story_event",
    "6.05",
    f"""WITH {TRAITS}, h AS (SELECT *, (region = 'west' AND duration_hours > 24 * 1000) AS hit FROM traits) SELECT fire_id, total_area_km2 FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h) ORDER BY total_area_km2 DESC, fire_id LIMIT 1""",
)
def _(spark, d):
    return P.story_event(traits(spark, d), (F.col("region") == "west") & (F.col("duration_hours") > 24 * 1000), "total_area_km2")
