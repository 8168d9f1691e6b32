"""Event trajectories: slices, morphology, activity, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, ranking
from ..operators import activity as A
from ..operators import geometry as G
from ..operators import trajectory as T
from .inputs import DAILY, FIRES, RINGS, SLICES, TRAITS, daily_growth, rounded, shaped_slices, slices, traits
from .registry import query


def trait_inputs(spark, d):
    """Traits with days instead of hours, as the feature build expects them."""
    t = traits(spark, d)
    return t.select(
        "fire_id", "year", "region", "total_area_km2", (F.col("duration_hours") / 24).alias("duration_days"),
        F.round(F.col("total_area_km2") / F.col("duration_hours") * 24, 9).alias("peak_growth_km2_per_day"),
    )


def features(spark, d):
    return T.morphology_features(slices(spark, d), trait_inputs(spark, d))


def time_table(spark, d):
    """Slices with regular octagon perimeters, measured, as a per-observation table."""
    s = slices(spark, d)
    x0, y0 = F.col("lon") * 100000, F.col("lat") * 100000
    ring = G.regular_ring(x0, y0, F.sqrt(F.col("cumulative_area_km2") / F.lit(3.141592653589793)) * 1000, 8)
    s = s.withColumn("ring", ring)
    m = G.ring_metrics(F.col("ring"))
    s = s.withColumns({"perimeter_km": m["perimeter"] / 1000, "compactness": m["compactness"], "width_km": m["width"] / 1000, "cx_m": m["cx"], "cy_m": m["cy"]})
    obs = s.withColumns({"area_km2": F.col("cumulative_area_km2"), "growth_km2": F.col("ring_area_km2")}).drop("ring")
    return T.fire_time_table(obs)


@query(
    "normalized_daily_slices",
    "5.12",
    f"""WITH {DAILY} SELECT fire_id, timestamp, CAST(row_number() OVER w - 1 AS INTEGER) AS slice_index, ring_area_km2, round(sum(ring_area_km2) OVER w, 6) AS cumulative_area_km2,
      round(coalesce(sqrt(sum(ring_area_km2) OVER w / nullif(sum(ring_area_km2) OVER (PARTITION BY fire_id), 0)), 0), 6) AS normalized_vase_width, CAST(year(timestamp) AS INTEGER) AS year, year(timestamp) IN (1996, 1998) AS supported
    FROM daily WINDOW w AS (PARTITION BY fire_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    daily = daily_growth(spark, d).select("fire_id", "timestamp", F.col("ring_area_km2").alias("dy_ar_km2"))
    out = T.normalize_daily(daily, day="timestamp", supported_years=[1996, 1998]).drop("dy_ar_km2")
    return rounded(out, "cumulative_area_km2", "normalized_vase_width")


@query(
    "as_of_day_features",
    "5.13",
    f"""WITH {SLICES}, r AS (SELECT fire_id, CAST(row_number() OVER w AS INTEGER) AS elapsed_observations, cumulative_area_km2 AS area_so_far_km2, round(sum(ring_area_km2) OVER w, 6) AS growth_so_far_km2, max(ring_area_km2) OVER w AS max_growth_so_far_km2,
      CAST(count(*) FILTER (ring_area_km2 > 0) OVER w AS BIGINT) AS active_days_so_far, round(avg(maximum_temperature_c) OVER w, 8) AS mean_tmax_so_far_c, round(avg(vpd_kpa) OVER w, 8) AS mean_vpd_so_far_kpa, round(avg(wind_speed_m_s) OVER w, 8) AS mean_wind_so_far_m_s,
      bool_and(climate_available) OVER w AS climate_complete_so_far FROM slices WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index ROWS UNBOUNDED PRECEDING))
    SELECT *, 'day ' || CAST(elapsed_observations AS VARCHAR) AS stage FROM r WHERE elapsed_observations IN (1, 2, 4, 8)""",
)
def _(spark, d):
    out = T.safe_stage_table(slices(spark, d))
    return rounded(rounded(out, "growth_so_far_km2"), "mean_tmax_so_far_c", "mean_vpd_so_far_kpa", "mean_wind_so_far_m_s", digits=8)


@query(
    "next_day_state_table",
    "5.14",
    f"""WITH {SLICES}, a AS (SELECT *, lead(ring_area_km2) OVER w AS nx, coalesce(lag(ring_area_km2) OVER w, 0) AS pv FROM slices WHERE climate_available WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index))
    SELECT fire_id, slice_index, year, maximum_temperature_c, minimum_temperature_c, vpd_kpa, wind_speed_m_s, round(ln(1 + greatest(nx, 0)), 6) AS next_growth_log1p, CAST(slice_index AS DOUBLE) AS elapsed_day,
      round(ln(1 + ring_area_km2), 6) AS current_growth_log1p, round(ln(1 + cumulative_area_km2), 6) AS current_cumulative_log1p, round(ring_area_km2 - pv, 6) AS growth_acceleration_km2 FROM a WHERE nx IS NOT NULL""",
)
def _(spark, d):
    out = T.state_model_table(slices(spark, d))
    return rounded(out, "next_growth_log1p", "current_growth_log1p", "current_cumulative_log1p", "growth_acceleration_km2")


@query(
    "observation_time_table",
    "5.15",
    f"""WITH {SLICES}, o AS (SELECT fire_id, timestamp, cumulative_area_km2 AS a, ring_area_km2 AS g, vpd_kpa AS v, CAST(row_number() OVER w - 1 AS INTEGER) AS i, CAST(count(*) OVER p AS INTEGER) AS n,
      CAST(coalesce(date_diff('day', lag(timestamp) OVER w, timestamp), 0) AS INTEGER) AS gap, date_diff('day', min(timestamp) OVER p, timestamp) AS el, date_diff('day', min(timestamp) OVER p, max(timestamp) OVER p) AS du, CAST(date_diff('day', max(timestamp) OVER p, timestamp) AS INTEGER) AS dt,
      avg(vpd_kpa) OVER p AS m, stddev_pop(vpd_kpa) OVER p AS sd, lag(cumulative_area_km2) OVER w AS pa, vpd_kpa - lag(vpd_kpa) OVER w AS dv, count(vpd_kpa) OVER p AS nv FROM slices WINDOW w AS (PARTITION BY fire_id ORDER BY timestamp), p AS (PARTITION BY fire_id)),
    s AS (SELECT *, coalesce((pa + a) / 2 * greatest(gap, 1), 0) AS vi FROM o)
    SELECT fire_id, timestamp, i AS observation_index, n AS observation_count, gap AS gap_days, round(coalesce(CAST(el AS DOUBLE) / nullif(du, 0), 0), 6) AS relative_age, dt AS days_to_terminal, round(g / nullif(a, 0), 6) AS proportional_growth,
      round(sqrt(a / pi()) - lag(sqrt(a / pi())) OVER w, 6) AS radius_change_km, round(sum(vi) OVER (PARTITION BY fire_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 3) AS volume_cumulative, round(dv, 6) AS vpd_kpa_change, round(CASE WHEN sd > 1e-12 THEN (v - m) / sd END, 6) AS vpd_kpa_z,
      round(CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY fire_id, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY fire_id, v) - 1) / 2.0) / nv END, 6) AS vpd_kpa_pct, i = 0 AS is_first, i = n - 1 AS is_terminal FROM s WINDOW w AS (PARTITION BY fire_id ORDER BY timestamp)""",
)
def _(spark, d):
    t = time_table(spark, d)
    cols = ["fire_id", "timestamp", "observation_index", "observation_count", "gap_days", "relative_age", "days_to_terminal", "proportional_growth", "radius_change_km", "volume_cumulative", "vpd_kpa_change", "vpd_kpa_z", "vpd_kpa_pct", "is_first", "is_terminal"]
    out = rounded(t.select(*cols), "volume_cumulative", digits=3)
    return rounded(out, "relative_age", "proportional_growth", "radius_change_km", "vpd_kpa_change", "vpd_kpa_z", "vpd_kpa_pct")


@query(
    "terminal_features",
    "5.16",
    f"""WITH {SLICES}, b AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY slice_index DESC) AS b, abs(ring_area_km2 - lag(ring_area_km2) OVER w) AS dg, first_value(slice_index) OVER (PARTITION BY fire_id ORDER BY ring_area_km2 DESC, slice_index) AS pk FROM slices WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index))
    SELECT fire_id, CAST(count(*) AS BIGINT) AS observation_count, round(covar_pop(-b, normalized_vase_width) FILTER (b <= 3) / nullif(var_pop(-b) FILTER (b <= 3), 0), 6) AS terminal_taper_slope, round(avg(maximum_temperature_c) FILTER (b <= 3), 8) AS terminal_window_mean,
      round(max(ring_area_km2) FILTER (b = 1) / max(ring_area_km2), 6) AS terminal_growth_fraction, round((max(ring_area_km2) FILTER (slice_index <= pk) + 1e-9) / (avg(ring_area_km2) FILTER (slice_index > pk) + 1e-9), 5) AS asymmetry, round(coalesce(sum(dg), 0), 6) AS growth_path_length FROM b GROUP BY 1""",
)
def _(spark, d):
    out = T.terminal_features(slices(spark, d)).select("fire_id", "observation_count", "terminal_taper_slope", "terminal_window_mean", "terminal_growth_fraction", "asymmetry", "growth_path_length")
    return rounded(rounded(rounded(out, "terminal_taper_slope", "terminal_growth_fraction", "growth_path_length"), "terminal_window_mean", digits=8), "asymmetry", digits=5)


@query("terminal_climate_features", "5.16")
def _(spark, d):
    out = T.terminal_features(slices(spark, d))
    cols = ["terminal_window_variance", "terminal_z", "terminal_percentile", "terminal_width_fraction", "climate_path_length"]
    return rounded(out.select("fire_id", *cols), *cols)


@query(
    "weighted_rank_score",
    "5.17",
    f"""WITH {TRAITS}, r AS (SELECT fire_id, (rank() OVER (ORDER BY total_area_km2) + (count(*) OVER (PARTITION BY total_area_km2) - 1) / 2.0) / count(*) OVER () AS a, (rank() OVER (ORDER BY duration_hours) + (count(*) OVER (PARTITION BY duration_hours) - 1) / 2.0) / count(*) OVER () AS b FROM traits)
    SELECT fire_id, round(a, 9) AS area_rank, round(b, 9) AS duration_rank, round(0.6 * a + 0.4 * b, 9) AS score FROM r""",
)
def _(spark, d):
    t = traits(spark, d).select("fire_id", "total_area_km2", "duration_hours")
    t = ranking.with_average_rank(t, "total_area_km2", "area_rank", pct=True)
    t = ranking.with_average_rank(t, "duration_hours", "duration_rank", pct=True)
    out = t.withColumn("score", 0.6 * F.col("area_rank") + 0.4 * F.col("duration_rank"))
    return rounded(out.select("fire_id", "area_rank", "duration_rank", "score"), "area_rank", "duration_rank", "score", digits=9)


# --- arrays ------------------------------------------------------------------

_ARR = f"""{RINGS}, arr AS (SELECT fire_id, list(ring_area_km2 ORDER BY slice_index) AS g, list(cumulative_area_km2 ORDER BY slice_index) AS c, list(timestamp ORDER BY slice_index) AS d, list(round(sqrt(cumulative_area_km2 / fin), 9) ORDER BY slice_index) AS w, len(list(1)) AS n FROM (SELECT *, max(cumulative_area_km2) OVER (PARTITION BY fire_id) AS fin FROM rings) GROUP BY 1)"""


def _interp(arr: str, q: float) -> str:
    pos = f"round({q}::DOUBLE * (len({arr}) - 1), 9)"
    lo = f"CAST(floor({pos}) AS INTEGER)"
    hi = f"least({lo} + 1, len({arr}) - 1)"
    return f"({arr}[{lo} + 1] + ({arr}[{hi} + 1] - {arr}[{lo} + 1]) * ({pos} - {lo}))"


@query(
    "array_functions",
    "8.04",
    f"""WITH {_ARR} SELECT fire_id, round({_interp('g', 0.3)}, 8) AS at_30pct, round(list_aggregate(g, 'quantile_cont', 0.75), 8) AS q75, round(CASE WHEN n > 1 THEN list_sum([abs(g[i + 1] - g[i]) FOR i IN generate_series(1, n - 1)]) ELSE 0 END, 6) AS path,
      round(CASE WHEN n > 1 THEN (g[2] - g[1]) END, 6) AS first_gradient, round(CASE WHEN n > 2 THEN (g[3] - g[1]) / 2 END, 8) AS second_gradient,
      round(coalesce(list_sum([(c[i + 1] + c[i]) / 2 FOR i IN generate_series(1, n - 1)]), 0), 8) AS volume FROM arr""",
)
def _(spark, d):
    a = T.growth_arrays(shaped_slices(spark, d))
    g = F.col("g")
    times = F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: i.cast("double"))
    out = a.select(
        "fire_id", arrays.interp(g, 0.3).alias("at_30pct"), arrays.quantile(g, 0.75).alias("q75"),
        arrays.total(F.transform(arrays.diff(g), lambda x: F.abs(x))).alias("path"),
        F.get(arrays.gradient(g), F.lit(0)).alias("first_gradient"), F.when(F.size(g) > 2, F.get(arrays.gradient(g), F.lit(1))).alias("second_gradient"),
        arrays.trapezoid(F.col("c"), times).alias("volume"),
    )
    return rounded(rounded(out, "first_gradient", "path"), "at_30pct", "q75", "second_gradient", "volume", digits=8)


_THR = "round(greatest(list_aggregate(g, 'quantile_cont', 0.75), list_max(g) * 0.25, 1e-9), 9)"
_RUNS = "len(list_filter(generate_series(1, n), lambda i: round(g[i], 9) >= thr AND (i = 1 OR round(g[i - 1], 9) < thr)))"


@query(
    "pulse_counts",
    "11.02",
    f"""WITH {_ARR}, t AS (SELECT *, {_THR} AS thr, round(greatest(0.1, list_aggregate(g, 'quantile_cont', 0.75), list_max(g) * 0.25), 9) AS thr2 FROM arr)
    SELECT fire_id, CAST({_RUNS} AS INTEGER) AS burst_runs, CAST(greatest({_RUNS} - 1, 0) AS INTEGER) AS reactivations, CAST(CASE WHEN n <= 1 THEN CASE WHEN g[1] > 0 THEN 1 ELSE 0 END ELSE len(list_filter(g, lambda v: round(v, 9) >= thr2)) END AS INTEGER) AS burst_days,
      CAST(len(list_filter(generate_series(2, n - 1), lambda i: g[i] > g[i - 1] AND g[i] > g[i + 1])) AS INTEGER) AS strict_maxima FROM t""",
)
def _(spark, d):
    return T.pulse_counts(shaped_slices(spark, d))


_FEAT = f"""{FIRES}, arr AS (SELECT fire_id, list(ring_area_km2 ORDER BY slice_index) AS g, list(cumulative_area_km2 ORDER BY slice_index) AS c, list(normalized_vase_width ORDER BY slice_index) AS w, list(timestamp ORDER BY slice_index) AS d, CAST(count(*) AS INTEGER) AS n,
  avg(vpd_kpa) FILTER (climate_available) AS mv, bool_and(climate_available) AS ca FROM slices GROUP BY 1),
f0 AS (SELECT a.*, t.year, t.region, t.duration_hours / 24 AS duration_days, greatest(t.total_area_km2, list_max(c), 1e-9) AS final, list_max(g) AS peak FROM arr a JOIN traits t ON t.fire_id = a.fire_id),
f1 AS (SELECT *, {_THR} AS thr, list_position(g, peak) - 1 AS pk, [round(x / final, 15) FOR x IN g] AS p FROM f0),
f AS (SELECT fire_id, region, final AS final_area_km2, duration_days, n AS observation_count, CAST({_RUNS} AS INTEGER) AS pulse_count, CAST(pk AS DOUBLE) / greatest(n - 1, 1) AS peak_timing, {_interp('c', 0.5)} / final AS front_loaded_fraction,
  CASE WHEN n = 1 THEN 0 ELSE list_sum([CASE WHEN round(CAST(i AS DOUBLE) / (n - 1), 9) >= 0.75 THEN g[i + 1] / final ELSE 0 END FOR i IN generate_series(0, n - 1)]) END AS late_growth_fraction, g[n] / peak AS terminal_taper_fraction,
  -list_sum([CASE WHEN x > 0 THEN x / final * ln(x / final) ELSE 0 END FOR x IN g]) / ln(greatest(n, 2)) AS growth_entropy,
  CASE WHEN n > 1 THEN list_avg([abs(w[i + 1] - w[i]) FOR i IN generate_series(1, n - 1)]) ELSE 0 END AS developmental_velocity,
  CASE WHEN n > 2 THEN list_avg([abs((w[i + 2] - w[i + 1]) - (w[i + 1] - w[i])) FOR i IN generate_series(1, n - 2)]) ELSE 0 END AS developmental_acceleration,
  {_interp('w', 0.5)} AS width_at_half, duration_days / greatest(2 * sqrt(final / pi()), 0.1) AS slenderness_days_per_width, {_interp('w', 0.3)} AS width_p03, {_interp('g', 0.7)} / final AS growth_p07, mv AS mean_vpd_kpa, ca AS climate_available FROM f1)"""
_SHOWN = ["final_area_km2", "peak_timing", "front_loaded_fraction", "late_growth_fraction", "terminal_taper_fraction", "growth_entropy", "developmental_velocity", "developmental_acceleration", "width_at_half", "slenderness_days_per_width", "width_p03", "growth_p07", "mean_vpd_kpa"]


@query(
    "morphology_features",
    "11.01",
    f"WITH {_FEAT} SELECT fire_id, region, duration_days, observation_count, pulse_count, climate_available, {', '.join(f'round({c}, 7) AS {c}' for c in _SHOWN)} FROM f",
)
def _(spark, d):
    out = features(spark, d).select("fire_id", "region", "duration_days", "observation_count", "pulse_count", "climate_available", *_SHOWN)
    return rounded(out, *_SHOWN, digits=7)


@query(
    "shape_labels",
    "11.03",
    f"""WITH {_FEAT}, q AS (SELECT round(quantile_cont(final_area_km2, 0.75), 9) AS a75, round(quantile_cont(final_area_km2, 0.9), 9) AS a90, round(quantile_cont(duration_days, 0.5), 9) AS d50, round(quantile_cont(slenderness_days_per_width, 0.75), 9) AS s75 FROM f)
    SELECT fire_id, CASE WHEN observation_count <= 1 OR duration_days <= 1 THEN 'single flash' WHEN round(slenderness_days_per_width, 9) >= s75 AND round(final_area_km2, 9) <= a75 THEN 'skinny persistent' WHEN round(final_area_km2, 9) >= a90 AND duration_days <= d50 THEN 'broad rapid'
      WHEN pulse_count >= 3 OR observation_count >= 6 THEN 'multi-pulse complex' WHEN round(peak_timing, 9) >= 0.66 THEN 'late surge' WHEN round(front_loaded_fraction, 9) >= 0.75 AND round(terminal_taper_fraction, 9) <= 0.35 THEN 'front-loaded plateau' ELSE 'compact steady' END AS shape_label FROM f, q""",
)
def _(spark, d):
    return T.shape_label(features(spark, d)).select("fire_id", "shape_label")


@query(
    "trajectory_milestones",
    "11.04",
    f"""WITH {_FEAT}, b AS (SELECT *, greatest(round(peak * 0.25, 9), 1e-9) AS qr, greatest(round(peak * 0.1, 9), round(final * 0.01, 9), 1e-9) AS tn FROM f1),
    s AS (SELECT *, list_filter(generate_series(0, n - 1), lambda i: round(g[i + 1], 9) >= qr AND (i = 0 OR round(g[i], 9) < qr)) AS st FROM b),
    m AS (SELECT fire_id, n, g, c, d, unnest(['first_observed_development', 'emergence_5pct_area', 'first_major_burst', 'peak_expansion', 'final_meaningful_expansion', 'geometric_quiescence', 'slowdown_after_peak', 'secondary_burst']) AS event_name,
      unnest([0, coalesce(list_min(list_filter(generate_series(0, n - 1), lambda i: round(c[i + 1] / final, 9) >= 0.05)), 0), coalesce(list_min(list_filter(generate_series(0, n - 1), lambda i: round(g[i + 1], 9) >= qr)), 0), pk,
        coalesce(list_max(list_filter(generate_series(0, n - 1), lambda i: round(g[i + 1], 9) >= tn)), n - 1), n - 1, CASE WHEN n > 2 THEN list_min(list_filter(generate_series(0, n - 1), lambda i: i > pk AND round(g[i + 1], 9) <= round(peak * 0.25, 9))) END, CASE WHEN n > 2 THEN st[2] END]) AS i FROM s)
    SELECT fire_id, event_name, CAST(i AS INTEGER) AS slice_index, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE round(CAST(i AS DOUBLE) / (n - 1), 9) END AS relative_time, d[i + 1] AS timestamp, g[i + 1] AS ring_area_km2, c[i + 1] AS cumulative_area_km2 FROM m WHERE i IS NOT NULL""",
)
def _(spark, d):
    return T.trajectory_milestones(slices(spark, d), trait_inputs(spark, d))


@query(
    "stage_table",
    "4.17",
    f"""WITH {FIRES}, r AS (SELECT s.*, t.total_area_km2, CASE WHEN n_obs = 1 THEN 0.5 ELSE round(CAST(slice_index AS DOUBLE) / (n_obs - 1), 9) END AS rt FROM slices s JOIN traits t ON t.fire_id = s.fire_id),
    g AS (SELECT *, CASE WHEN rt < 0.25 THEN 'early' WHEN rt < 0.5 THEN 'expansion' WHEN rt < 0.75 THEN 'mature' ELSE 'terminal' END AS stage FROM r)
    SELECT fire_id, stage, round(sum(ring_area_km2 / total_area_km2), 6) AS stage_growth_fraction, round(avg(normalized_vase_width), 7) AS stage_width_mean, round(max(normalized_vase_width) - min(normalized_vase_width), 6) AS stage_width_change, CAST(count(*) AS BIGINT) AS stage_observation_count,
      round(avg(vpd_kpa) FILTER (climate_available), 8) AS stage_vpd_mean_kpa, CASE stage WHEN 'early' THEN 0.125::DOUBLE WHEN 'expansion' THEN 0.375 WHEN 'mature' THEN 0.625 ELSE 0.875 END AS stage_midpoint FROM g GROUP BY ALL""",
)
def _(spark, d):
    out = T.stage_table(slices(spark, d), trait_inputs(spark, d))
    out = out.select("fire_id", "stage", "stage_growth_fraction", "stage_width_mean", "stage_width_change", "stage_observation_count", "stage_vpd_mean_kpa", "stage_midpoint")
    return rounded(rounded(rounded(out, "stage_growth_fraction", "stage_width_change"), "stage_width_mean", digits=7), "stage_vpd_mean_kpa", digits=8)


@query(
    "composite_profile",
    "4.18",
    f"""WITH {RINGS}, s AS (SELECT fire_id, coalesce(round(CAST(slice_index AS DOUBLE) / nullif(max(slice_index) OVER (PARTITION BY fire_id), 0), 9), 0.5) AS t, least(normalized_vase_width, 1) AS w FROM shaped),
    g AS (SELECT unnest([round(i / 10.0::DOUBLE, 9) FOR i IN generate_series(0, 10)]) AS x), p AS (SELECT fire_id, x, max(t) FILTER (t <= x) AS lo, min(t) FILTER (t >= x) AS hi, arg_max(w, t) FILTER (t <= x) AS wl, arg_min(w, t) FILTER (t >= x) AS wh FROM s CROSS JOIN g GROUP BY ALL),
    v AS (SELECT fire_id, x, CASE WHEN lo IS NULL THEN wh WHEN hi IS NULL THEN wl WHEN hi = lo THEN wl ELSE wl + (wh - wl) * (x - lo) / (hi - lo) END AS w FROM p)
    SELECT x AS relative_time, round(quantile_cont(w, 0.5), 6) AS width, round(quantile_cont(w, 0.25), 6) AS q25, round(quantile_cont(w, 0.75), 6) AS q75, CAST(count(*) AS BIGINT) AS n_fires FROM v GROUP BY 1""",
)
def _(spark, d):
    return rounded(T.composite_profile(shaped_slices(spark, d), 11), "width", "q25", "q75")


@query(
    "climate_features",
    "4.16",
    f"""WITH {FIRES}, s AS (SELECT s.*, greatest(maximum_temperature_c - 26, 0) AS rain, 30 - 4 * minimum_temperature_c AS fuel, maximum_temperature_c + 2 * vpd_kpa AS erc, t.region, month(timestamp) AS mo, coalesce(round(CAST(slice_index AS DOUBLE) / nullif(max(slice_index) OVER (PARTITION BY s.fire_id), 0), 9), 0.5) AS rt FROM slices s JOIN traits t ON t.fire_id = s.fire_id WHERE climate_available),
    q AS (SELECT round(quantile_cont(maximum_temperature_c, 0.9), 9) AS h, round(quantile_cont(vpd_kpa, 0.9), 9) AS v, round(quantile_cont(wind_speed_m_s, 0.9), 9) AS w, round(quantile_cont(fuel, 0.1), 9) AS fu, round(quantile_cont(erc, 0.9), 9) AS er FROM s), m AS (SELECT region, mo, quantile_cont(vpd_kpa, 0.5) AS med FROM s GROUP BY ALL)
    SELECT fire_id, CAST(count(*) AS BIGINT) AS slice_count, round(avg(CAST(maximum_temperature_c >= h AS INTEGER)), 6) AS hot_day_fraction, round(avg(CAST(vpd_kpa >= v AS INTEGER)), 6) AS high_vpd_day_fraction, round(avg(CAST(wind_speed_m_s >= w AS INTEGER)), 6) AS windy_day_fraction, round(avg(CAST(rain > 0 AS INTEGER)), 6) AS wet_day_fraction, round(avg(CAST(round(fuel, 9) <= fu AS INTEGER)), 6) AS dry_1000hr_fuel_day_fraction, round(avg(CAST(round(erc, 9) >= er AS INTEGER)), 6) AS high_erc_day_fraction, round(avg(vpd_kpa), 8) AS mean_vpd_kpa, min(vpd_kpa) AS min_daily_vpd_kpa,
      round(avg(vpd_kpa - med), 8) AS mean_vpd_kpa_region_month_anomaly, round(avg(vpd_kpa) FILTER (rt <= 1.0 / 3), 8) AS vpd_kpa_early_mean, round(avg(vpd_kpa) FILTER (rt > 2.0 / 3), 8) AS vpd_kpa_late_mean FROM s JOIN m USING (region, mo), q GROUP BY 1""",
)
def _(spark, d):
    more = {"precipitation_mm": F.greatest(F.col("maximum_temperature_c") - 26, F.lit(0.0)), "fuel_moisture_1000hr_pct": 30 - 4 * F.col("minimum_temperature_c"), "energy_release_component": F.col("maximum_temperature_c") + 2 * F.col("vpd_kpa")}
    out = T.climate_features(slices(spark, d).withColumns(more), traits(spark, d))
    fr, eight = [f"{name}_fraction" for name in T.EXTREME_DAYS], ["mean_vpd_kpa", "mean_vpd_kpa_region_month_anomaly", "vpd_kpa_early_mean", "vpd_kpa_late_mean"]
    return rounded(rounded(out.select("fire_id", "slice_count", *fr, "min_daily_vpd_kpa", *eight), *fr), *eight, digits=8)


# --- activity ----------------------------------------------------------------


def _observations(spark, d):
    return shaped_slices(spark, d).select("fire_id", "timestamp", F.col("ring_area_km2").alias("growth_km2"))


def _summary(spark, d):
    return A.activity_summary(_observations(spark, d))


@query("activity_events", "11.05")
def _(spark, d):
    return rounded(A.detect_activity_events(_summary(spark, d)), "activity", "relative_to_peak")


_ACT = f"""{_ARR}, a0 AS (SELECT fire_id, g, d, CAST(n AS INTEGER) AS n, list_max(g) AS peak FROM arr), a1 AS (SELECT *, list_position(g, peak) - 1 AS pk, greatest(0.1, round(peak * 0.25, 9)) AS pt FROM a0),
a2 AS (SELECT *, coalesce(list_max(list_filter(generate_series(0, n - 1), lambda i: g[i + 1] >= pt)), pk) AS fi FROM a1),
a3 AS (SELECT *, coalesce(list_min(list_filter(generate_series(0, n - 1), lambda i: i > fi AND i + 2 <= n AND g[i + 1] <= pt AND g[i + 2] <= pt)), CASE WHEN fi < n - 1 THEN fi + 1 END) AS qi FROM a2)"""


@query(
    "annotated_states",
    "11.06",
    f"""WITH {_ACT}, u AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM a3)
    SELECT fire_id, CAST(i AS INTEGER) AS observation_index, d[i + 1] AS timestamp, g[i + 1] AS activity, CASE WHEN coalesce(i >= qi, false) THEN CASE WHEN g[i + 1] >= round(greatest(pt, peak * 0.1), 9) THEN 'reactivation' ELSE 'quiescence' END
      WHEN g[i + 1] >= round(peak * 0.5, 9) THEN 'major expansion' WHEN g[i + 1] >= round(greatest(pt, peak * 0.1), 9) THEN 'active expansion' ELSE 'low activity' END AS developmental_state,
      i = pk AS is_peak_expansion, i = fi AS is_final_meaningful_expansion, coalesce(i = qi, false) AS is_quiescence_onset FROM u""",
)
def _(spark, d):
    return A.annotate_states(_summary(spark, d)).drop("is_expansion_pulse")


@query(
    "developmental_traits",
    "11.07",
    f"""WITH {_ACT} SELECT fire_id, n AS observation_count, round(list_sum(g), 6) AS final_area_km2, peak AS peak_expansion_magnitude_km2, CAST(len(list_filter(g, lambda v: v >= pt)) AS INTEGER) AS number_of_active_observations, round(CAST(len(list_filter(g, lambda v: v >= pt)) AS DOUBLE) / n, 6) AS active_fraction,
      round(g[n] / peak, 6) AS terminal_taper_fraction, round(g[1] - g[n], 6) AS growth_asymmetry_km2, CAST(n - 1 - fi AS INTEGER) AS terminal_lag_observations, CAST(date_diff('day', d[fi + 1], d[n]) AS INTEGER) AS terminal_lag_days, CAST(coalesce(n - qi, 0) AS INTEGER) AS quiescent_persistence FROM a3""",
)
def _(spark, d):
    out = A.developmental_traits(time_table(spark, d), _summary(spark, d))
    cols = ["fire_id", "observation_count", "final_area_km2", "peak_expansion_magnitude_km2", "number_of_active_observations", "active_fraction", "terminal_taper_fraction", "growth_asymmetry_km2", "terminal_lag_observations", "terminal_lag_days", "quiescent_persistence"]
    return rounded(out.select(*cols), "active_fraction", "terminal_taper_fraction", "growth_asymmetry_km2", "final_area_km2")


@query("developmental_traits_full", "11.07")
def _(spark, d):
    out = A.developmental_traits(time_table(spark, d), _summary(spark, d))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(
    "usability_flags",
    "11.08",
    f"""WITH {SLICES}, g AS (SELECT *, coalesce(date_diff('day', lag(timestamp) OVER (PARTITION BY fire_id ORDER BY timestamp), timestamp), 0) AS gap FROM slices)
    SELECT fire_id, CAST(count(*) AS INTEGER) AS observation_count, CAST(max(gap) AS INTEGER) AS max_gap_days, CAST(count(*) FILTER (climate_available) AS BIGINT) AS climate_records, CAST(count(*) - 1 AS INTEGER) AS usable_transitions, count(*) >= 3 AS usable_for_morphology,
      count(*) >= 3 AND max(gap) <= 2 AS usable_for_terminal_observation_analysis, count(*) >= 5 AS usable_for_clustering FROM g GROUP BY 1""",
)
def _(spark, d):
    out = A.qc_table(time_table(spark, d), _summary(spark, d))
    return out.select("fire_id", "observation_count", "max_gap_days", "climate_records", "usable_transitions", "usable_for_morphology", "usable_for_terminal_observation_analysis", "usable_for_clustering")


@query(
    "ending_classes",
    "11.08",
    f"""WITH {SLICES}, g AS (SELECT *, coalesce(date_diff('day', lag(timestamp) OVER (PARTITION BY fire_id ORDER BY timestamp), timestamp), 0) AS gap FROM slices), p AS (SELECT fire_id, count(*) AS n, max(gap) AS mg, max(timestamp) AS t1 FROM g GROUP BY 1)
    SELECT fire_id, CASE WHEN n < 3 THEN 'too few observations' WHEN mg > 400 OR n < 2 THEN 'sequence gap near ending' WHEN t1 < DATE '2001-01-01' THEN 'uncertain or censored ending' ELSE 'probable cessation' END AS qc_class FROM p""",
)
def _(spark, d):
    t = time_table(spark, d)
    p = t.groupBy("fire_id").agg(F.count(F.lit(1)).alias("n"), F.max("gap_days").alias("mg"), F.max("timestamp").alias("t1"))
    # gaps between orders are long, so the gap limit is rescaled to the driver tables
    scaled = F.when(F.col("mg") > 400, 3).otherwise(0)
    cls = A.ending_class(F.col("n"), scaled, F.lit(2), F.col("t1"), F.lit("2001-01-01").cast("date"))
    return p.select("fire_id", cls.alias("qc_class"))


@query(
    "usable_sample_counts",
    "4.24",
    f"""WITH {RINGS}, n AS (SELECT fire_id, count(*) AS n FROM rings GROUP BY 1) SELECT 'usable_for_morphology' AS flag, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS n_fires FROM n UNION ALL SELECT 'usable_for_clustering', count(*) FILTER (n >= 5) FROM n""",
)
def _(spark, d):
    qc = A.qc_table(time_table(spark, d), _summary(spark, d))
    return A.usable_counts(qc).where("flag in ('usable_for_morphology', 'usable_for_clustering')")


_PEAKS = f"{_ARR}, pk AS (SELECT fire_id, list_position(g, list_max(g)) - 1 AS i FROM arr)"


@query(
    "peak_centered_rows",
    "11.09",
    f"""WITH {_PEAKS} SELECT r.fire_id, 'peak expansion' AS anchor_event_type, CAST(pk.i AS INTEGER) AS anchor_index, CAST(r.slice_index - pk.i AS INTEGER) AS lag, CAST(date_diff('day', a.timestamp, r.timestamp) AS INTEGER) AS lag_days, r.ring_area_km2 AS activity
    FROM pk JOIN rings a ON a.fire_id = pk.fire_id AND a.slice_index = pk.i JOIN rings r ON r.fire_id = pk.fire_id AND abs(r.slice_index - pk.i) <= 3""",
)
def _(spark, d):
    ev = A.detect_activity_events(_summary(spark, d)).where("event_type = 'peak expansion'")
    rows = shaped_slices(spark, d).select("fire_id", F.col("slice_index").alias("observation_index"), "timestamp", F.col("ring_area_km2").alias("activity"))
    return A.event_centered(rows, ev, 3)


@query("alignment_quality", "11.10")
def _(spark, d):
    t = time_table(spark, d).withColumn("activity", F.col("growth_km2"))
    out = A.alignment_quality(t, A.detect_activity_events(_summary(spark, d)), ["vpd_kpa", "wind_speed_m_s"])
    return rounded(out, "mean_activity_variance", "peak_concentration", "direction_consistency")


@query(
    "interpolated_trajectories",
    "11.11",
    f"""WITH {RINGS}, s AS (SELECT fire_id, round(CAST(date_diff('day', min(timestamp) OVER p, timestamp) AS DOUBLE) / nullif(date_diff('day', min(timestamp) OVER p, max(timestamp) OVER p), 0), 9) AS t, ring_area_km2 AS v, n_obs FROM shaped WINDOW p AS (PARTITION BY fire_id)),
    g AS (SELECT unnest([round(i / 4.0::DOUBLE, 9) FOR i IN generate_series(0, 4)]) AS x), p AS (SELECT fire_id, x, max(t) FILTER (t <= x) AS lo, min(t) FILTER (t >= x) AS hi, arg_max(v, t) FILTER (t <= x) AS vl, arg_min(v, t) FILTER (t >= x) AS vh FROM s CROSS JOIN g WHERE n_obs >= 2 GROUP BY ALL),
    v AS (SELECT fire_id, x, CASE WHEN hi = lo THEN vl ELSE vl + (vh - vl) * (x - lo) / (hi - lo) END AS y FROM p) SELECT fire_id, x AS relative_age, round(y / max(abs(y)) OVER (PARTITION BY fire_id), 6) AS scaled FROM v""",
)
def _(spark, d):
    t = time_table(spark, d)
    out = A.interp_trajectory(t, ["growth_km2"], bins=5, scaled=["growth_km2"]).where("growth_km2 is not null")
    grid = F.array(*[F.lit(i / 4) for i in range(5)])
    both = out.select("fire_id", F.explode(F.arrays_zip(grid.alias("x"), F.col("growth_km2").alias("y"))).alias("z"))
    return rounded(both.select("fire_id", F.col("z.x").alias("relative_age"), F.col("z.y").alias("scaled")), "scaled")


@query(
    "end_aligned_quartiles",
    "11.12",
    f"""WITH {RINGS}, b AS (SELECT 1 - row_number() OVER (PARTITION BY fire_id ORDER BY timestamp DESC) AS step, ring_area_km2 AS v FROM rings)
    SELECT CAST(step AS INTEGER) AS step, round(quantile_cont(v, 0.25), 8) AS q0, round(quantile_cont(v, 0.5), 8) AS q1, round(quantile_cont(v, 0.75), 8) AS q2, CAST(count(*) AS BIGINT) AS n FROM b WHERE step > -7 GROUP BY 1""",
)
def _(spark, d):
    rows = A.end_aligned(_observations(spark, d), "growth_km2", 7)
    return rounded(A.aligned_quantiles(rows, "value", "step"), "q0", "q1", "q2", digits=8)


@query(
    "outlier_scenarios",
    "11.12",
    f"""WITH {TRAITS}, t AS (SELECT fire_id, row_number() OVER (ORDER BY total_area_km2 DESC, fire_id) AS r FROM traits), j AS (SELECT fire_id, ring_area_km2 AS v, r FROM daily JOIN t USING (fire_id)), m AS (SELECT avg(v) AS v FROM j GROUP BY fire_id),
    x AS (SELECT 'all fires' AS scenario, fire_id, v FROM j UNION ALL SELECT 'without largest fire', fire_id, v FROM j WHERE r > 1 UNION ALL SELECT 'without largest three', fire_id, v FROM j WHERE r > 3)
    SELECT scenario, CAST(count(DISTINCT fire_id) AS BIGINT) AS n_fires, round(avg(v), 6) AS mean_activity, max(v) AS max_activity, round(quantile_cont(v, 0.5), 7) AS median_activity FROM x GROUP BY 1
    UNION ALL SELECT 'equal fire weights', (SELECT count(DISTINCT fire_id) FROM j), (SELECT round(avg(v), 6) FROM j), (SELECT max(v) FROM j), round(quantile_cont(v, 0.5), 7) FROM m""",
)
def _(spark, d):
    sizes = traits(spark, d).select("fire_id", F.col("total_area_km2").alias("final_area_km2"))
    out = A.outlier_scenarios(_observations(spark, d), sizes)
    return rounded(rounded(out, "mean_activity"), "median_activity", digits=7)
