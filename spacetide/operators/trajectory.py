"""Event trajectories: normalised slices, running features, morphology, milestones, stages.

An event has at most one slice per day, so its ordered arrays and windows are
bounded by the calendar. Thresholds over the whole population come from the
exact distributed quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..functions import ranking

KEY = "fire_id"
DIGITS = 9
PROFILE_POINTS = 11
CLIMATE = ("maximum_temperature_c", "minimum_temperature_c", "vpd_kpa", "wind_speed_m_s")


def _by_slice() -> W:
    return W.partitionBy(KEY).orderBy("slice_index")


def _running() -> W:
    return _by_slice().rowsBetween(W.unboundedPreceding, 0)


def clipped(c: str) -> Column:
    """Missing or negative growth counts as zero."""
    return F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))


def normalize_daily(daily: DataFrame, area: str = "dy_ar_km2", day: str = "date", supported_years: Sequence[int] | None = None) -> DataFrame:
    """slice_index, ring area, cumulative area and width (0 where the final area is 0)."""
    order = W.partitionBy(KEY).orderBy(day)
    total = F.sum("ring_area_km2").over(W.partitionBy(KEY))
    out = (
        daily.withColumn("ring_area_km2", clipped(area))
        .withColumn("slice_index", F.row_number().over(order) - 1)
        .withColumn("cumulative_area_km2", F.sum("ring_area_km2").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("normalized_vase_width", F.coalesce(F.sqrt(C.ratio(F.col("cumulative_area_km2"), total)), F.lit(0.0)))
        .withColumn("year", F.year(day))
    )
    if supported_years is not None:
        out = out.withColumn("supported", F.col("year").isin(*supported_years))
    return out


def safe_stage_table(slices: DataFrame, targets: DataFrame | None = None, at: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """As-of-day features at observation 1, 2, 4, 8; nothing after that day is read."""
    run = _running()
    growth = clipped("ring_area_km2")
    cols = {
        "elapsed_observations": F.row_number().over(_by_slice()),
        "area_so_far_km2": F.col("cumulative_area_km2"),
        "growth_so_far_km2": F.sum(growth).over(run),
        "max_growth_so_far_km2": F.max(growth).over(run),
        "active_days_so_far": F.count(F.when(growth > 0, 1)).over(run),
        "mean_tmax_so_far_c": F.avg("maximum_temperature_c").over(run),
        "mean_vpd_so_far_kpa": F.avg("vpd_kpa").over(run),
        "mean_wind_so_far_m_s": F.avg("wind_speed_m_s").over(run),
        "climate_complete_so_far": F.min("climate_available").over(run),
    }
    out = slices.select(KEY, "slice_index", *[c.alias(n) for n, c in cols.items()]).where(
        F.col("elapsed_observations").isin(*at)
    )
    out = out.withColumn("stage", F.concat(F.lit("day "), F.col("elapsed_observations").cast("string"))).drop("slice_index")
    return out if targets is None else out.join(targets, KEY, "left")


def state_model_table(slices: DataFrame, climate: Sequence[str] = CLIMATE) -> DataFrame:
    """Next-day growth against today's state. Rows without climate are dropped before the shift."""
    w = _by_slice()
    ok = slices.where("climate_available")
    prev = F.coalesce(F.lag("ring_area_km2").over(w), F.lit(0.0))
    out = ok.withColumns(
        {
            "next_growth_km2": F.lead("ring_area_km2").over(w),
            "growth_acceleration_km2": F.coalesce(F.col("ring_area_km2"), F.lit(0.0)) - prev,
        }
    )
    out = out.dropna(subset=["next_growth_km2", *climate])
    return out.select(
        KEY, "slice_index", "year", *climate,
        C.log1p_clipped("next_growth_km2").alias("next_growth_log1p"),
        F.col("slice_index").cast("double").alias("elapsed_day"),
        C.log1p_clipped("ring_area_km2").alias("current_growth_log1p"),
        C.log1p_clipped("cumulative_area_km2").alias("current_cumulative_log1p"),
        "growth_acceleration_km2",
    )


def fire_time_table(obs: DataFrame, climate: Sequence[str] = CLIMATE) -> DataFrame:
    """Per observation: clock, size and shape change, space-time volume, climate change and rank.

    ``obs`` has timestamp, area_km2 (cumulative), growth_km2 and, where perimeters
    are known, perimeter_km, compactness, width_km, cx_m, cy_m.
    """
    w = W.partitionBy(KEY).orderBy("timestamp")
    whole = W.partitionBy(KEY)
    first, last = F.min("timestamp").over(whole), F.max("timestamp").over(whole)
    gap = F.coalesce(F.datediff("timestamp", F.lag("timestamp").over(w)), F.lit(0))
    has = set(obs.columns)
    base = obs.withColumns(
        {
            "observation_index": F.row_number().over(w) - 1,
            "observation_count": F.count(F.lit(1)).over(whole).cast("int"),
            "gap_days": gap,
            "elapsed_days": F.datediff("timestamp", first).cast("double"),
            "duration_days": F.datediff(last, first).cast("double"),
            "days_to_terminal": F.datediff("timestamp", last),
            "radius_km": C.equivalent_radius("area_km2"),
        }
    )
    change = lambda c: F.col(c) - F.lag(c).over(w)
    step = F.coalesce((F.lag("area_km2").over(w) + F.col("area_km2")) / 2 * F.greatest(F.col("gap_days"), F.lit(1)), F.lit(0.0))
    cols = {
        "relative_age": F.coalesce(C.ratio(F.col("elapsed_days"), F.col("duration_days")), F.lit(0.0)),
        "proportional_growth": C.ratio(F.col("growth_km2"), F.col("area_km2")),
        "radius_change_km": change("radius_km"),
        "volume_increment": step,
        "is_first": F.col("observation_index") == 0,
        "is_terminal": F.col("observation_index") == F.col("observation_count") - 1,
    }
    for c in ("perimeter_km", "width_km"):
        if c in has:
            cols[f"{c.removesuffix('_km')}_change_km"] = change(c)
    if {"cx_m", "cy_m"} <= has:
        cols["centroid_shift_km"] = F.coalesce(F.hypot(change("cx_m"), change("cy_m")) / 1000.0, F.lit(0.0))
    for c in climate:
        if c in has:
            sd = F.stddev_pop(c).over(whole)
            cols[f"{c}_change"] = change(c)
            cols[f"{c}_z"] = F.when(sd > 1e-12, (F.col(c) - F.avg(c).over(whole)) / sd)
            cols[f"{c}_pct"] = ranking.percent_rank_average(c, [KEY])
    out = base.withColumns(cols)
    return out.withColumn("volume_cumulative", F.sum("volume_increment").over(w.rowsBetween(W.unboundedPreceding, 0)))


def terminal_features(slices: DataFrame, width: str = "normalized_vase_width", climate: str = "maximum_temperature_c") -> DataFrame:
    """Shape of the ending: last-three-window slope, mean and variance, taper, asymmetry, path length."""
    back = W.partitionBy(KEY).orderBy(F.desc("slice_index"))
    w = _by_slice()
    s = slices.withColumns(
        {
            "_b": F.row_number().over(back),
            "_g": clipped("ring_area_km2"),
            "_pct": ranking.percent_rank_average(climate, [KEY]),
        }
    ).withColumns({"_dg": F.abs(F.col("_g") - F.lag("_g").over(w)), "_dc": F.abs(F.col(climate) - F.lag(climate).over(w))})
    end = F.col("_b") <= 3
    x, y = F.when(end, -F.col("_b").cast("double")), F.when(end, F.col(width))
    slope = C.ratio(F.covar_pop(x, y), F.var_pop(x))
    peak_at = F.max(F.struct("_g", (-F.col("slice_index")).alias("i")))
    s = s.withColumn("_peak", -peak_at.over(W.partitionBy(KEY))["i"])
    before = F.max(F.when(F.col("slice_index") <= F.col("_peak"), F.col("_g")))
    after = F.avg(F.when(F.col("slice_index") > F.col("_peak"), F.col("_g")))
    last = lambda c: F.max(F.when(F.col("_b") == 1, F.col(c)))
    sd = F.stddev_pop(climate)
    return s.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("observation_count"),
        slope.alias("terminal_taper_slope"),
        F.avg(F.when(end, F.col(climate))).alias("terminal_window_mean"),
        F.when(F.count(F.when(end, F.col(climate))) > 1, F.var_samp(F.when(end, F.col(climate)))).alias("terminal_window_variance"),
        F.when(sd > 1e-12, (last(climate) - F.avg(climate)) / sd).alias("terminal_z"),
        last("_pct").alias("terminal_percentile"),
        C.ratio(last("_g"), F.max("_g")).alias("terminal_growth_fraction"),
        C.ratio(last(width), F.max(width)).alias("terminal_width_fraction"),
        ((before + 1e-9) / (after + 1e-9)).alias("asymmetry"),
        F.coalesce(F.sum("_dg"), F.lit(0.0)).alias("growth_path_length"),
        F.coalesce(F.sum("_dc"), F.lit(0.0)).alias("climate_path_length"),
    )


# --- pulses ------------------------------------------------------------------


def burst_threshold(g: Column) -> Column:
    return F.round(F.greatest(A.quantile(g, 0.75), F.array_max(g) * 0.25, F.lit(1e-9)), DIGITS)


def burst_runs(g: Column) -> Column:
    """(a) number of runs at or above max(q75, quarter of the peak)."""
    runs = A.let(burst_threshold(g), lambda t: F.size(A.run_starts(F.transform(g, lambda v: F.round(v, DIGITS) >= t))))
    return F.when(F.array_max(g) > 0, runs).otherwise(0)


def burst_days(g: Column) -> Column:
    """(b) number of days at or above max(0.1, q75, quarter of the peak)."""
    cut = F.round(F.greatest(F.lit(0.1), A.quantile(g, 0.75), F.array_max(g) * 0.25), DIGITS)
    days = A.let(cut, lambda t: F.size(F.filter(g, lambda v: F.round(v, DIGITS) >= t)))
    return F.when(F.size(g) <= 1, F.when(F.get(g, F.lit(0)) > 0, 1).otherwise(0)).when(F.array_max(g) <= 0, 0).otherwise(days)


def strict_maxima(g: Column) -> Column:
    """(c) interior values greater than both neighbours."""
    idx = F.when(F.size(g) >= 3, F.sequence(F.lit(1), F.size(g) - 2)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(idx, lambda i: (F.get(g, i) > F.get(g, i - 1)) & (F.get(g, i) > F.get(g, i + 1))))


def growth_arrays(slices: DataFrame, *aggs: Column) -> DataFrame:
    """One row per event with its ordered growth, cumulative area, width and dates."""
    filled = F.coalesce(F.last("cumulative_area_km2", ignorenulls=True).over(_running()), F.lit(0.0))
    s = slices.withColumns({"_g": clipped("ring_area_km2"), "_c": filled, "_w": clipped("normalized_vase_width")})
    rows = F.array_sort(F.collect_list(F.struct("slice_index", "_g", "_c", "_w", "timestamp")))
    packed = s.groupBy(KEY).agg(rows.alias("_r"), *aggs)
    part = lambda f: F.transform("_r", lambda r: r[f])
    return packed.withColumns({"g": part("_g"), "c": part("_c"), "w": part("_w"), "days": part("timestamp")}).drop("_r")


def pulse_counts(slices: DataFrame) -> DataFrame:
    a = growth_arrays(slices)
    runs = burst_runs(F.col("g"))
    return a.select(
        KEY, runs.alias("burst_runs"), F.greatest(runs - 1, F.lit(0)).alias("reactivations"),
        burst_days(F.col("g")).alias("burst_days"), strict_maxima(F.col("g")).alias("strict_maxima"),
    )


# --- morphology --------------------------------------------------------------


def relative_time(n: Column, i: Column) -> Column:
    """Position in 0..1; a single observation sits at 0.5."""
    return F.when(n <= 1, F.lit(0.5)).otherwise(F.round(i / F.greatest(n - 1, F.lit(1)), DIGITS))


def _entropy(p: Column, n: Column) -> Column:
    present = F.filter(p, lambda v: v > 0)
    s = F.aggregate(present, F.lit(0.0), lambda a, v: a + v * F.ln(v))
    return F.when(F.size(present) > 0, -s / F.ln(F.greatest(n, F.lit(2)).cast("double"))).otherwise(F.lit(0.0))


def shape_columns(g: Column, c: Column, w: Column, final: Column, duration: Column) -> dict[str, Column]:
    """Geometry features of ordered growth, cumulative and width arrays."""
    n = F.size(g)
    peak = F.array_max(g)
    frac = F.transform(g, lambda v: v / final)
    late = F.filter(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(relative_time(n, i) >= 0.75, F.get(g, i) / final)), lambda v: v.isNotNull()
    )
    absmean = lambda a: A.mean(F.transform(a, lambda v: F.abs(v)))
    runs = burst_runs(g)
    out = {
        "observation_count": n,
        "pulse_count": runs,
        "reactivation_count": F.greatest(runs - 1, F.lit(0)),
        "peak_timing": (F.array_position(g, peak) - 1).cast("double") / F.greatest(n - 1, F.lit(1)),
        "front_loaded_fraction": A.interp(c, 0.5) / final,
        "late_growth_fraction": A.total(late),
        "terminal_taper_fraction": F.when(peak > 0, F.get(g, n - 1) / peak).otherwise(F.lit(0.0)),
        "growth_entropy": _entropy(frac, n),
        "developmental_velocity": absmean(A.diff(w)),
        "developmental_acceleration": absmean(A.diff(A.diff(w))),
        "width_at_quarter": A.interp(w, 0.25),
        "width_at_half": A.interp(w, 0.50),
        "width_at_three_quarter": A.interp(w, 0.75),
        "slenderness_days_per_width": C.slenderness(duration, final),
    }
    for i in range(PROFILE_POINTS):
        out[f"width_p{i:02d}"] = A.interp(w, i / (PROFILE_POINTS - 1))
    for i in range(PROFILE_POINTS):
        out[f"growth_p{i:02d}"] = A.interp(g, i / (PROFILE_POINTS - 1)) / final
    return out


def climate_means() -> list[Column]:
    """Means over the slices with climate."""
    ok = F.col("climate_available")
    when = lambda c: F.when(ok, F.col(c))
    return [
        F.avg(when("maximum_temperature_c")).alias("mean_maximum_temperature_c"),
        F.avg(when("minimum_temperature_c")).alias("mean_minimum_temperature_c"),
        F.avg(when("vpd_kpa")).alias("mean_vpd_kpa"),
        F.max(when("vpd_kpa")).alias("max_vpd_kpa"),
        F.avg(when("wind_speed_m_s")).alias("mean_wind_speed_m_s"),
        F.avg(F.when(ok, F.col("wind_present").cast("double"))).alias("wind_present_fraction"),
        F.bool_and(ok).alias("climate_available"),
    ]


def with_final_area(packed: DataFrame, traits: DataFrame) -> DataFrame:
    joined = packed.join(traits, KEY)
    return joined.withColumn("final_area_km2", F.greatest("total_area_km2", F.array_max("c"), F.lit(1e-9)))


def morphology_features(slices: DataFrame, traits: DataFrame) -> DataFrame:
    """17 geometry scalars, two 11-point profiles and 6 climate means per event.

    ``traits``: fire_id, year, region, total_area_km2, duration_days, peak_growth_km2_per_day.
    """
    a = with_final_area(growth_arrays(slices, *climate_means()), traits)
    shape = shape_columns(F.col("g"), F.col("c"), F.col("w"), F.col("final_area_km2"), F.greatest(F.col("duration_days"), F.lit(0.0)))
    kept = [KEY, "year", "region", "final_area_km2", "duration_days", "peak_growth_km2_per_day"]
    means = [
        "mean_maximum_temperature_c", "mean_minimum_temperature_c", "mean_vpd_kpa", "max_vpd_kpa", "mean_wind_speed_m_s",
        "wind_present_fraction", "climate_available",
    ]
    return a.select(*kept, *[c.alias(n) for n, c in shape.items()], *means)


SHAPE_QUANTILES = {  # column -> probabilities behind the population thresholds
    "final_area_km2": (0.75, 0.90),
    "duration_days": (0.50,),
    "slenderness_days_per_width": (0.75,),
}


def shape_thresholds(features: DataFrame) -> dict[str, float]:
    """Four population quantiles from one pass (a bounded probe)."""
    q = ranking.column_quantiles(features, SHAPE_QUANTILES)
    (a75, a90), (d50,), (s75,) = q.values()
    return {"area_q75": a75, "area_q90": a90, "duration_q50": d50, "slender_q75": s75}


def shape_label(features: DataFrame, thresholds: dict[str, float] | None = None, name: str = "shape_label") -> DataFrame:
    """First of seven rules that holds."""
    t = {k: round(v, DIGITS) for k, v in (thresholds or shape_thresholds(features)).items()}
    r = lambda c: F.round(F.col(c), DIGITS)
    rules = [
        ((F.col("observation_count") <= 1) | (F.col("duration_days") <= 1), "single flash"),
        ((r("slenderness_days_per_width") >= t["slender_q75"]) & (r("final_area_km2") <= t["area_q75"]), "skinny persistent"),
        ((r("final_area_km2") >= t["area_q90"]) & (F.col("duration_days") <= t["duration_q50"]), "broad rapid"),
        ((F.col("pulse_count") >= 3) | (F.col("observation_count") >= 6), "multi-pulse complex"),
        (r("peak_timing") >= 0.66, "late surge"),
        ((r("front_loaded_fraction") >= 0.75) & (r("terminal_taper_fraction") <= 0.35), "front-loaded plateau"),
    ]
    return features.withColumn(name, C.choose(F.col(KEY), rules, "compact steady"))


def _first_at(g: Column, test) -> Column:
    """First zero-based position passing ``test``, NULL if none."""
    idx = F.sequence(F.lit(0), F.size(g) - 1)
    return F.array_min(F.filter(idx, lambda i: test(F.get(g, i), i)))


def _last_at(g: Column, test) -> Column:
    idx = F.sequence(F.lit(0), F.size(g) - 1)
    return F.array_max(F.filter(idx, lambda i: test(F.get(g, i), i)))


def trajectory_milestones(slices: DataFrame, traits: DataFrame) -> DataFrame:
    """Named moments of each event; a (name, index) pair occurs once."""
    a = with_final_area(growth_arrays(slices), traits)
    r = lambda c: F.round(c, DIGITS)
    g, final = F.col("g"), F.col("final_area_km2")
    a = a.withColumns({"_peak": F.array_max("g"), "_n": F.size("g")}).withColumns(
        {"_at": (F.array_position("g", F.col("_peak")) - 1).cast("int"), "_q": F.greatest(r(F.col("_peak") * 0.25), F.lit(1e-9))}
    )
    peak, n, at, quarter = F.col("_peak"), F.col("_n"), F.col("_at"), F.col("_q")
    grows = peak > 0
    starts = A.run_starts(F.transform(g, lambda v: r(v) >= quarter))
    last_big = _last_at(g, lambda v, i: r(v) >= F.greatest(r(peak * 0.10), r(final * 0.01), F.lit(1e-9)))
    specs = [
        ("first_observed_development", F.lit(0)),
        ("emergence_5pct_area", F.coalesce(_first_at(F.col("c"), lambda v, i: r(v / final) >= 0.05), F.lit(0))),
        ("first_major_burst", F.when(grows, F.coalesce(_first_at(g, lambda v, i: r(v) >= quarter), F.lit(0))).otherwise(0)),
        ("peak_expansion", at),
        ("final_meaningful_expansion", F.when(grows, F.coalesce(last_big, n - 1)).otherwise(n - 1)),
        ("geometric_quiescence", n - 1),
        ("slowdown_after_peak", F.when((n > 2) & grows, _first_at(g, lambda v, i: (i > at) & (r(v) <= r(peak * 0.25))))),
        ("secondary_burst", F.when((n > 2) & grows, F.get(starts, F.lit(1)))),
    ]
    moments = F.array(*[F.struct(F.lit(name).alias("event_name"), i.cast("int").alias("slice_index")) for name, i in specs])
    out = a.select(KEY, "g", "c", "days", "_n", F.explode(moments).alias("m")).where("m.slice_index is not null")
    i = F.col("m.slice_index")
    return out.select(
        KEY, "m.event_name", "m.slice_index", relative_time(F.col("_n"), i).alias("relative_time"),
        F.get("days", i).alias("timestamp"), F.get("g", i).alias("ring_area_km2"), F.get("c", i).alias("cumulative_area_km2"),
    )


STAGES = [("early", 0.0, 0.25), ("expansion", 0.25, 0.5), ("mature", 0.5, 0.75), ("terminal", 0.75, 1.01)]


def stage_table(slices: DataFrame, traits: DataFrame, stages=STAGES) -> DataFrame:
    """Growth share, width and climate in four stages of relative time."""
    whole = W.partitionBy(KEY)
    n = F.count(F.lit(1)).over(whole)
    s = slices.withColumns(
        {"_t": relative_time(n, F.row_number().over(_by_slice()) - 1), "_g": clipped("ring_area_km2"), "_w": clipped("normalized_vase_width"),
         "_cmax": F.max("cumulative_area_km2").over(whole)}
    ).join(traits.select(KEY, "total_area_km2"), KEY)
    final = F.greatest("total_area_km2", F.coalesce("_cmax", F.lit(0.0)), F.lit(1e-9))
    t = F.col("_t")
    named = s.withColumn("stage", C.choose(t, [((t >= lo) & (t < hi), name) for name, lo, hi in stages], None))
    mid = F.create_map(*[F.lit(v) for name, lo, hi in stages for v in (name, (lo + min(hi, 1.0)) / 2)])
    ok = lambda c: F.avg(F.when(F.col("climate_available"), F.col(c).cast("double")))
    out = named.where("stage is not null").groupBy(KEY, "stage").agg(
        F.sum(F.col("_g") / final).alias("stage_growth_fraction"), F.avg("_w").alias("stage_width_mean"),
        (F.max("_w") - F.min("_w")).alias("stage_width_change"), F.count(F.lit(1)).alias("stage_observation_count"),
        ok("maximum_temperature_c").alias("stage_tmax_mean_c"), ok("vpd_kpa").alias("stage_vpd_mean_kpa"),
        ok("wind_speed_m_s").alias("stage_wind_mean_m_s"), ok("wind_present").alias("stage_wind_present_fraction"),
    )
    return out.withColumn("stage_midpoint", mid[F.col("stage")])


def composite_profile(slices: DataFrame, n_grid: int = 41) -> DataFrame:
    """Median and quartiles of width on a common relative-time grid, over all events.

    Each event is interpolated inside its own row; the quantiles per grid point
    run over the whole population, so they use the distributed form.
    """
    span = F.max("slice_index").over(W.partitionBy(KEY))
    rel = F.coalesce(C.ratio(F.col("slice_index"), span), F.lit(0.5))
    s = slices.withColumns({"_t": F.round(rel, DIGITS), "_w": F.least(clipped("normalized_vase_width"), F.lit(1.0))})
    packed = s.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("_t", "_w"))).alias("p"))
    grid = F.array(*[F.lit(round(i / (n_grid - 1), DIGITS)) for i in range(n_grid)])
    points = packed.select(
        KEY, F.explode(F.transform(grid, lambda x: F.struct(x.alias("relative_time"), piecewise(F.col("p"), "_t", "_w", x).alias("width")))).alias("q")
    ).select(KEY, "q.*")
    q = ranking.quantile_table(points, "width", [0.25, 0.5, 0.75], ["relative_time"])
    n = packed.select(KEY).distinct().agg(F.count(F.lit(1)))
    return q.select("relative_time", F.col("q1").alias("width"), F.col("q0").alias("q25"), F.col("q2").alias("q75"), n.scalar().alias("n_fires"))


def piecewise(points: Column, x_field: str, y_field: str, x: Column) -> Column:
    """Linear interpolation at ``x`` through sorted points (struct array), clamped at both ends."""
    below = F.filter(points, lambda p: p[x_field] <= x)
    above = F.filter(points, lambda p: p[x_field] >= x)
    lo, hi = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    width = hi[x_field] - lo[x_field]
    inner = lo[y_field] + (hi[y_field] - lo[y_field]) * F.coalesce(F.try_divide(x - lo[x_field], width), F.lit(0.0))
    return F.when(lo.isNull(), hi[y_field]).when(hi.isNull(), lo[y_field]).otherwise(inner)


#: Column and population quantile of each extreme-day flag (none: above 0).
EXTREME_DAYS = {
    "hot_day": ("maximum_temperature_c", 0.90),
    "high_vpd_day": ("vpd_kpa", 0.90),
    "windy_day": ("wind_speed_m_s", 0.90),
    "wet_day": ("precipitation_mm", None),
    "dry_1000hr_fuel_day": ("fuel_moisture_1000hr_pct", 0.10),
    "high_erc_day": ("energy_release_component", 0.90),
}


def climate_features(slices: DataFrame, meta: DataFrame, climate: Sequence[str] = CLIMATE) -> DataFrame:
    """Per event: extreme-day shares, mean / min / max, mean region-month anomaly, thirds of relative time.

    ``meta``: fire_id, region. Extreme days are at or above the population's 0.90 quantile, dry fuel at or below its 0.10
    quantile, wet days above 0; a flag whose column ``slices`` lacks is left out.
    """
    ok = slices.where("climate_available").join(meta.select(KEY, "region"), KEY)
    ok = ok.withColumn("month", F.month("timestamp"))
    flags = {name: rule for name, rule in EXTREME_DAYS.items() if rule[0] in slices.columns}
    cuts = ranking.column_quantiles(ok, {c: [q] for c, q in flags.values() if q is not None})
    span = F.max("slice_index").over(W.partitionBy(KEY))
    rel = F.coalesce(C.ratio(F.col("slice_index"), span), F.lit(0.5))
    s = ok.withColumn("time_bin", C.time_bin(F.round(rel, DIGITS)))
    for name, (c, q) in flags.items():
        value = F.round(F.col(c), DIGITS)
        cut = 0.0 if q is None else cuts[c][0]
        edge = F.lit(None if cut is None else round(cut, DIGITS)).cast("double")
        s = s.withColumn(name, (value > edge if q is None else value >= edge if q > 0.5 else value <= edge).cast("double"))
    long = ok.select("region", "month", *climate).unpivot(["region", "month"], list(climate), "_metric", "_value")
    med = ranking.quantile_table(long, "_value", [0.5], ["region", "month", "_metric"])
    med = med.groupBy("region", "month").agg(*[F.max(F.when(F.col("_metric") == c, F.col("q0"))).alias(f"_m_{c}") for c in climate])
    s = s.join(med, ["region", "month"], "left").withColumns({f"_a_{c}": F.col(c) - F.col(f"_m_{c}") for c in climate})
    aggs = [F.count(F.lit(1)).alias("slice_count")]
    aggs += [F.avg(name).alias(f"{name}_fraction") for name in flags]
    for c in climate:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"min_daily_{c}"), F.max(c).alias(f"max_daily_{c}"), F.avg(f"_a_{c}").alias(f"mean_{c}_region_month_anomaly")]
        aggs += [F.avg(F.when(F.col("time_bin") == b, F.col(c))).alias(f"{c}_{b}_mean") for b in ("early", "middle", "late")]
    return s.groupBy(KEY).agg(*aggs)


