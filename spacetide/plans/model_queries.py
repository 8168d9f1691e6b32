"""Standardising, components, folds, regressions, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import qcut
from ..operators import models as M
from ..operators import trajectory as T
from ..session import cut_lineage
from .inputs import CLIMATE, RINGS, TRAITS, rounded, slices, table, traits
from .join_queries import AXES, POINTS, by_axis, feature_points
from .registry import query
from .trajectory_queries import features, trait_inputs

NEAR, FAR = AXES[:32], AXES[32:]


def _space(spark, d):
    return M.with_logs(cut_lineage(features(spark, d), "features"))


def _vectors(spark, d):
    return by_axis(feature_points(spark, d)).withColumn("id", F.col("id").cast("string")).withColumnRenamed("id", "fire_id")


@query(
    "standardized_traits",
    "11.13",
    f"""WITH {TRAITS}, s AS (SELECT avg(total_area_km2) AS m, stddev_pop(total_area_km2) AS sd, quantile_cont(duration_hours, 0.5) AS m2, stddev_pop(duration_hours) AS sd2 FROM traits)
    SELECT fire_id, round((total_area_km2 - m) / sd, 6) AS area_z, round((duration_hours - m2) / sd2, 6) AS duration_robust_z FROM traits, s""",
)
def _(spark, d):
    t = traits(spark, d)
    t = M.standardize(t, ["total_area_km2"], "mean")
    t = M.standardize(t, ["duration_hours"], "median", "r_")
    return rounded(t.select("fire_id", F.col("z_total_area_km2").alias("area_z"), F.col("r_duration_hours").alias("duration_robust_z")), "area_z", "duration_robust_z")


@query("morphospace_scores", "11.14")
def _(spark, d):
    f = _space(spark, d)
    fit = M.pca(f, M.morphospace_columns())
    out = fit.scores(f, 3)
    cols = ["morph_pc1", "morph_pc2", "morph_pc3"]
    return rounded(out.select("fire_id", *cols), *cols)


@query("mean_centred_components", "11.14")
def _(spark, d):
    v = _vectors(spark, d)
    return rounded(M.pca(v, AXES, "mean").scores(v, 2, "pc").select("fire_id", "pc1", "pc2"), "pc1", "pc2")


@query("component_top_loadings", "6.03 11.15")
def _(spark, d):
    f = _space(spark, d)
    return rounded(M.top_loadings(M.pca(f, M.morphospace_columns()), f, 3), "loading")


@query("component_ablation", "11.15")
def _(spark, d):
    f = _space(spark, d)
    cols = M.morphospace_columns()
    profiles = [c for c in cols if "_p0" in c or "_p1" in c]
    sets = {
        "all": cols, "scalars": [c for c in cols if c not in profiles], "profiles": profiles, "no final area": [c for c in cols if "final_area" not in c],
        "one per cluster": M.correlated_clusters(f, cols),
    }
    return M.pca_ablation(f, sets, "all")


@query("component_duration_sensitivity", "11.15")
def _(spark, d):
    f = _space(spark, d)
    return M.duration_sensitivity(f, M.morphospace_columns(), (0, 2, 4, 8, 10), least=50)


@query("component_bootstrap", "11.16")
def _(spark, d):
    f = _space(spark, d)
    for value, name in (("duration_days", "duration_bin"), ("final_area_km2", "area_bin"), ("year", "year_bin")):
        f = qcut(f, value, 4, name)
    return M.pca_bootstrap(f, M.morphospace_columns(), ["duration_bin", "area_bin", "year_bin", "region"], reps=60)


@query("null_model_spectra", "11.17")
def _(spark, d):
    found = M.null_replicates(_space(spark, d), slices(spark, d), trait_inputs(spark, d), M.morphospace_columns(), reps=24)
    return found.join(M.null_model_summary(found), "null_model", "left")


@query("correlated_feature_clusters", "11.18")
def _(spark, d):
    f = _space(spark, d)
    chosen = M.correlated_clusters(f, M.morphospace_columns())
    names = F.array(*[F.lit(c) for c in chosen])
    return spark.range(1).select(F.posexplode(names).alias("position", "feature"))


@query(
    "spearman_effects",
    "11.19",
    f"""WITH {TRAITS}, p AS (SELECT 'lon' AS predictor, lon AS x, 'total_area_km2' AS response, total_area_km2 AS y FROM traits UNION ALL SELECT 'lat', lat, 'total_area_km2', total_area_km2 FROM traits
      UNION ALL SELECT 'lon', lon, 'duration_hours', duration_hours FROM traits UNION ALL SELECT 'lat', lat, 'duration_hours', duration_hours FROM traits),
    r AS (SELECT predictor, response, rank() OVER (PARTITION BY predictor, response ORDER BY x) + (count(*) OVER (PARTITION BY predictor, response, x) - 1) / 2.0 AS u, rank() OVER (PARTITION BY predictor, response ORDER BY y) + (count(*) OVER (PARTITION BY predictor, response, y) - 1) / 2.0 AS v FROM p)
    SELECT predictor, response, CAST(count(*) AS BIGINT) AS n, round(covar_pop(u, v) / sqrt(var_pop(u) * var_pop(v)), 6) AS spearman_rho FROM r GROUP BY ALL""",
)
def _(spark, d):
    out = M.spearman_effects(traits(spark, d), ["lon", "lat"], ["total_area_km2", "duration_hours"])
    return rounded(out.select("predictor", "response", "n", "spearman_rho"), "spearman_rho")


@query("spearman_effect_p_values", "11.19")
def _(spark, d):
    out = M.spearman_effects(features(spark, d), ["mean_vpd_kpa", "mean_wind_speed_m_s"], ["growth_entropy", "peak_timing"])
    return rounded(out, "spearman_rho", "p_value")


_HEX = "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


@query(
    "fold_assignments",
    "11.20",
    f"""WITH {TRAITS}, g AS (SELECT list_sort(list(DISTINCT region)) AS n FROM traits) SELECT fire_id, CAST({_HEX.format(x='fire_id')} % 5 AS INTEGER) AS random_fold, CAST(list_position(n, region) - 1 AS INTEGER) AS region_fold,
      CAST({_HEX.format(x="region || '_' || CAST(year AS VARCHAR)")} % 5 AS INTEGER) AS region_year_fold, CAST(CASE WHEN year BETWEEN 1999 AND 2004 THEN 0 END AS INTEGER) AS year_fold FROM traits, g""",
)
def _(spark, d):
    t = traits(spark, d).select("fire_id", "region", "year")
    for kind, name in (("random_fire", "random_fold"), ("region_block", "region_fold"), ("region_year_hash", "region_year_fold"), ("year_block", "year_fold")):
        t = M.fold_ids(t, kind).withColumnRenamed("fold", name)
    return t.select("fire_id", "random_fold", "region_fold", "region_year_fold", "year_fold")


@query("blocked_ridge_models", "11.21")
def _(spark, d):
    f = _space(spark, d)
    sets = {"climate means": ["mean_maximum_temperature_c", "mean_vpd_kpa", "mean_wind_speed_m_s"], "shape": ["peak_timing", "growth_entropy", "observation_count"]}
    return rounded(M.ridge_table(f, sets, ["final_area_km2", "front_loaded_fraction"], ["random_fire", "region_block", "region_year_hash", "year_block"]), "r2")


@query("ols_fold_scores", "11.22")
def _(spark, d):
    f = _space(spark, d)
    return rounded(M.ols_cv(f, ["peak_timing", "growth_entropy", "observation_count"], ["log_final_area_km2", "developmental_velocity"], "random_fire", "shape predicts size"), "r2")


@query("ols_split_score", "11.22")
def _(spark, d):
    f = _space(spark, d)
    r2 = M.ols_split_r2(f, ["peak_timing", "growth_entropy"], "developmental_velocity")
    return spark.range(1).select(F.lit("entropy and timing").alias("model"), F.round(F.lit(r2).cast("double"), 6).alias("r2"))


@query("next_day_growth_models", "11.21 5.14")
def _(spark, d):
    state = T.state_model_table(slices(spark, d)).join(traits(spark, d).select("fire_id", "region"), "fire_id", "left")
    return rounded(M.next_day_models(state, CLIMATE[:3], CLIMATE), "r2")


@query("early_stage_models", "11.22 5.13")
def _(spark, d):
    f = _space(spark, d)
    targets = M.pca(f, M.morphospace_columns()).scores(f, 3).select("fire_id", "region", "year", "morph_pc1", "morph_pc2", "morph_pc3")
    return rounded(M.stage_models(T.safe_stage_table(slices(spark, d), targets), ["morph_pc1", "morph_pc2", "morph_pc3"], least=200), "r2")


#: Clipped and standardised vectors, the distinct ones at four digits and the farthest-point choice: a row a round, ``ch`` the points chosen so far.
_REPS = f"""{POINTS}, e AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pt),
    q AS (SELECT i, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM e GROUP BY 1), c AS (SELECT id, i, least(greatest(x, lo), hi) AS x FROM e JOIN q USING (i)),
    s AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS sd FROM c GROUP BY 1), z AS (SELECT id, list((x - m) / sd ORDER BY i) AS v FROM c JOIN s USING (i) GROUP BY 1),
    ds AS (SELECT list_transform(v, lambda x: round(x, 4)) AS v, min(id) AS id FROM z GROUP BY 1), md AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, quantile_cont(x, 0.5) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ds) GROUP BY 1)),
    sq AS (SELECT id, v, round(list_sum(list_transform(list_zip(v, m), lambda p: pow(p[1] - p[2], 2))), 9) AS d FROM ds, md),
    r AS (SELECT 1 AS n, list_value((SELECT arg_max(v, (-d, id)) FROM sq)) AS ch, list_value((SELECT max((-d, id)) FROM sq)[2]) AS ids
      UNION ALL SELECT n + 1, list_append(ch, arg_max(v, (t, id))), list_append(ids, arg_max(id, (t, id))) FROM (SELECT n, ch, ids, ds.id, ds.v, list_min(list_transform(ch, lambda o: round(pow(list_distance(o, ds.v), 2), 9))) AS t FROM r, ds WHERE n < 36) GROUP BY n, ch, ids),
    ch AS (SELECT unnest(ch) AS v, unnest(ids) AS id, generate_subscripts(ids, 1) AS n FROM r WHERE n = (SELECT max(n) FROM r))"""


@query(
    "farthest_point_representatives",
    "11.23",
    f"""WITH RECURSIVE {_REPS}, k AS (SELECT arg_min(ch.n, (round(list_distance(z.v, ch.v), 9), ch.n)) AS n FROM z, ch GROUP BY z.id), cn AS (SELECT n, count(*) AS c FROM k GROUP BY 1),
    nb AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS rk FROM z a JOIN z b ON a.id <> b.id WHERE a.id IN (SELECT id FROM ch))
    SELECT 'M' || lpad(CAST(n AS VARCHAR), 2, '0') AS representative_id, id AS fire_id, c AS represented_fire_count, (SELECT string_agg(CAST(other AS VARCHAR), ',' ORDER BY rk) FROM nb WHERE nb.id = ch.id AND rk <= 6) AS neighbor_ids, round(list_sum(v), 6) AS sum_of_axes FROM ch LEFT JOIN cn USING (n)""",
)
def _(spark, d):
    p = by_axis(feature_points(spark, d)).withColumnRenamed("id", "fire_id")
    found = M.representatives(p, AXES, k=36, neighbors=6)
    along = F.aggregate(F.array(*AXES), F.lit(0.0), lambda t, v: t + v)
    return found.select("representative_id", "fire_id", "represented_fire_count", "neighbor_ids", F.round(along, 6).alias("sum_of_axes"))


_SPACE = f"""{POINTS}, e AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pt), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1),
    z AS (SELECT CAST(id AS VARCHAR) AS id, list((x - m) / sd ORDER BY i) FILTER (i <= 32) AS n, list((x - m) / sd ORDER BY i) FILTER (i > 32) AS f FROM e JOIN s USING (i) GROUP BY 1)"""


@query(
    "matched_pairs",
    "11.24",
    f"""WITH {_SPACE}, p AS (SELECT a.id AS x, b.id AS y, round(list_distance(a.n, b.n), 9) AS dn, round(list_distance(a.f, b.f), 9) AS df FROM z a JOIN z b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dn, y) AS rk FROM p),
    b AS (SELECT x AS fire_id_a, arg_max(y, (df, -rk)) AS fire_id_b, arg_max(dn, (df, -rk)) AS near_distance, max(df) AS far_distance FROM k WHERE rk <= 29 GROUP BY 1)
    SELECT fire_id_a, fire_id_b, round(near_distance, 6) AS near_distance, round(far_distance, 6) AS far_distance FROM b ORDER BY b.far_distance DESC, b.near_distance DESC, fire_id_a LIMIT 8""",
)
def _(spark, d):
    return rounded(M.matched_pairs(_vectors(spark, d), NEAR, FAR, k=29, n_pairs=8), "near_distance", "far_distance")


def _effect_sql(label: str, near: str, far: str) -> str:
    return f"""SELECT '{label}' AS matching_basis, (SELECT count(*) FROM w WHERE id <> o) AS n_pairs, round(dn, 6) AS near_distance_median, round(pd, 6) AS other_distance_median, round(rd, 6) AS random_distance_median, round((pd - rd) / sd, 6) AS standardized_effect
      FROM (SELECT quantile_cont(d, 0.5) AS dn, quantile_cont(o, 0.5) AS pd FROM (SELECT arg_min(round(list_distance(a.{near}, b.{near}), 9), (round(list_distance(a.{near}, b.{near}), 9), b.id)) AS d,
          arg_min(round(list_distance(a.{far}, b.{far}), 9), (round(list_distance(a.{near}, b.{near}), 9), b.id)) AS o FROM z a JOIN z b ON a.id <> b.id GROUP BY a.id)),
        (SELECT quantile_cont(d, 0.5) AS rd, stddev_pop(d) AS sd FROM (SELECT round(list_distance(a.{far}, b.{far}), 9) AS d FROM w JOIN z a ON a.id = w.id JOIN z b ON b.id = w.o WHERE w.id <> w.o))"""


@query(
    "matched_population_effect",
    "11.24",
    f"""WITH {_SPACE}, h AS (SELECT id, row_number() OVER (ORDER BY substr(md5(id), 1, 13)) AS r FROM z), w AS (SELECT a.id, b.id AS o FROM h a JOIN h b ON b.r = a.r % (SELECT count(*) FROM h) + 1)
    {_effect_sql("similar morphology", "n", "f")} UNION ALL {_effect_sql("similar climate", "f", "n")}""",
)
def _(spark, d):
    v = _vectors(spark, d)
    a = M.matched_population(v, NEAR, FAR, "similar morphology")
    out = a.unionByName(M.matched_population(v, FAR, NEAR, "similar climate"))
    return rounded(out, "near_distance_median", "other_distance_median", "random_distance_median", "standardized_effect")


@query(
    "label_purity_of_neighbors",
    "11.25",
    f"""WITH {POINTS}, o AS (SELECT s.id, s.label, t.label AS tl, row_number() OVER (PARTITION BY s.id ORDER BY round(list_distance(s.v, t.v), 9), t.id) AS rk FROM pt s JOIN pt t ON s.id <> t.id), n AS (SELECT * FROM o WHERE rk <= 15),
    pu AS (SELECT id, avg(CAST(label = tl AS INTEGER)) AS p FROM n GROUP BY 1), cn AS (SELECT id, tl, count(*) AS c FROM n GROUP BY ALL), ls AS (SELECT id, list(c ORDER BY c DESC) AS c FROM cn GROUP BY 1), mg AS (SELECT avg(CASE WHEN len(c) > 1 THEN (c[1] - c[2]) / 15.0 ELSE 1 END) AS m FROM ls),
    ch AS (SELECT sum(c * c) / pow(sum(c), 2) AS h FROM (SELECT count(*) AS c FROM pt GROUP BY label)) SELECT round((SELECT avg(p) FROM pu), 6) AS mean_purity, round(m, 6) AS mean_margin, round(h, 6) AS chance FROM mg, ch""",
)
def _(spark, d):
    return rounded(M.category_overlap(feature_points(spark, d), "v", "label", 15), "mean_purity", "mean_margin", "chance")


@query(
    "medoid_coverage",
    "11.25",
    f"""WITH RECURSIVE {_REPS}, k AS (SELECT unnest([4, 8, 12, 16, 24, 30, 36]) AS k), d AS (SELECT k.k, z.id, round(min(list_distance(z.v, ch.v)), 9) AS d FROM z, ch, k WHERE ch.n <= k.k GROUP BY ALL)
    SELECT CAST(k AS INTEGER) AS n_medoids, round(quantile_cont(d, 0.5), 6) AS median_nearest_distance, round(quantile_cont(d, 0.9), 6) AS p90_nearest_distance, round(avg(CAST(d <= 1 AS INTEGER)), 6) AS mass_within_1 FROM d GROUP BY 1""",
)
def _(spark, d):
    p = by_axis(feature_points(spark, d)).withColumnRenamed("id", "fire_id")
    z = M.representative_space(p, AXES)
    out = M.medoid_coverage(z, [v for _, v in M.chosen_points(z, AXES, 36)], "v", [4, 8, 12, 16, 24, 30, 36])
    return rounded(out, "median_nearest_distance", "p90_nearest_distance", "mass_within_1")


def _support_sql(leg: str, side: str, other: str) -> str:
    return f"SELECT '{leg}' AS leg, round(quantile_cont(d, 0.5), 6) AS median_distance FROM (SELECT min(round(list_distance(a.v, b.v), 9)) AS d FROM pt a JOIN pt b ON a.id <> b.id AND a.id % 2 = {side} AND b.id % 2 = {other} GROUP BY a.id)"


@query(
    "support_distances",
    "3.12",
    f"WITH {POINTS} " + " UNION ALL ".join(_support_sql(*x) for x in (("observed_nn", 0, 0), ("synthetic_nn", 1, 1), ("observed_to_synthetic", 0, 1), ("synthetic_to_observed", 1, 0))),
)
def _(spark, d):
    p = feature_points(spark, d)
    half = F.col("id") % 2
    return rounded(M.support_distances(p.where(half == 0), p.where(half == 1), "v"), "median_distance")


@query("trait_clusters", "11.26")
def _(spark, d):
    t = traits(spark, d).select("fire_id", "total_area_km2", "duration_hours")
    table_, labels = M.cluster_traits(t, ["total_area_km2", "duration_hours"])
    chosen = labels.groupBy("profile").agg(F.count(F.lit(1)).alias("n_fires"))
    return chosen.join(F.broadcast(table_.where("selected").select("candidate_k")))


@query(
    "leakage_check",
    "11.27",
    f"""WITH {RINGS} SELECT 'day ' || CAST(k AS VARCHAR) AS stage, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_leaking FROM shaped, (VALUES (1), (2), (4), (8)) v(k) WHERE slice_index + 1 = k GROUP BY k""",
)
def _(spark, d):
    return M.leakage_check(slices(spark, d))
