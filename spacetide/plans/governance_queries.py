"""Lakehouse governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import hull as H
from ..operators import joins as J
from ..sources import tables as T
from .geometry_queries import perimeters
from .inputs import SLICES, TRAITS, places, rounded, slices, table, traits
from .registry import query

VERSIONS = {"geometry": "g1", "climate": "c1", "events": "e1", "traits": "t1", "vase": "v1", "render": "r1"}


@query(
    "schema_violations",
    "12.01",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS m FROM orders) SELECT o_orderkey, CASE m WHEN 0 THEN 'missing required column ''processing_version''; column ''trait_version'' expected string' WHEN 1 THEN 'column ''year'' expected integer' WHEN 2 THEN 'column ''total_area_km2'' expected number' ELSE '' END AS errors FROM o""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    m = F.col("o_orderkey") % 5
    ident = F.col("o_orderkey").cast("string")
    good = '"trait_version":"t1","processing_version":"p1","year":1996,"region":"west","extra":[1,2]'
    text = (
        F.when(m == 0, F.concat(F.lit('{"fire_id":"'), ident, F.lit('","trait_version":2,"year":1996,"region":"west"}')))
        .when(m == 1, F.concat(F.lit('{"fire_id":"'), ident, F.lit('","trait_version":"t1","processing_version":"p1","year":true,"region":"west"}')))
        .when(m == 2, F.concat(F.lit('{"fire_id":"'), ident, F.lit('","total_area_km2":"big",' + good + "}")))
        .when(m == 3, F.concat(F.lit('{"fire_id":"'), ident, F.lit('","total_area_km2":null,' + good + "}")))
        .otherwise(F.concat(F.lit('{"fire_id":"'), ident, F.lit('","total_area_km2":12.5,"duration_hours":24,' + good + "}")))
    )
    out = G.validate_json(o.select("o_orderkey", text.alias("j")), "j", G.SCHEMAS["fire_traits"])
    return out.select("o_orderkey", F.concat_ws("; ", "errors").alias("errors"))


@query(
    "quality_flags",
    "12.02",
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < 5 THEN 'empty_geometry' END, CASE WHEN l_returnflag = 'R' THEN 'invalid_geometry' END, CASE WHEN l_discount - 0.02 <= 0 THEN 'nonpositive_area' END, CASE WHEN l_linenumber = 7 THEN 'newly_added_geometry' END], lambda x: x IS NOT NULL), ',') AS geometry_flags,
      CASE WHEN l_linenumber - 1 <= 0 THEN 'invalid_expected_steps' WHEN round(1 - l_quantity / ((l_linenumber - 1) * 10), 12) > 0.05 THEN l_linestatus || '_missing_gt_5pct' WHEN round(1 - l_quantity / ((l_linenumber - 1) * 10), 12) > 0 THEN l_linestatus || '_missing_le_5pct' ELSE '' END AS climate_flags,
      NOT (l_linenumber > 1 AND round(1 - l_quantity / ((l_linenumber - 1) * 10), 12) > 0.05) AS passed FROM lineitem""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    g = G.geometry_qc(F.col("l_discount") - 0.02, F.col("l_returnflag") != "R", F.col("l_quantity") < 5, F.col("l_linenumber") == 7)
    c = G.climate_qc(F.col("l_quantity"), (F.col("l_linenumber") - 1) * 10, F.col("l_linestatus"))
    return li.select("l_orderkey", "l_linenumber", F.concat_ws(",", g).alias("geometry_flags"), F.concat_ws(",", c).alias("climate_flags"), G.climate_passed(c).alias("passed"))


def _sha(component: str, inputs: str, identity: str = '"fire_id":"\' || fire_id || \'"', version: str | None = None) -> str:
    return f"""'{component}:' || substr(sha256('{{"component":"{component}","identity":{{{identity}}},"inputs":{{{inputs}}},"versions":{{"{component}":"{VERSIONS[component]}"}}}}'), 1, 24)"""


@query(
    "component_key_chain",
    "12.03",
    f"""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS fire_id, c_name FROM customer), g AS (SELECT *, {_sha('geometry', '"method":"canonical_fire_time_geometry","source_geometry_hash":"' + "' || c_name || '" + '"')} AS geometry_cache_key FROM a),
    c AS (SELECT *, {_sha('climate', '"climate_source":"gridmet","geometry_cache_key":"' + "' || geometry_cache_key || '" + '","temporal_resolution":"daily","variables":["tmmx","vpd"]')} AS climate_cache_key FROM g),
    v AS (SELECT *, {_sha('vase', '"climate_cache_key":"' + "' || climate_cache_key || '" + '","geometry_cache_key":"' + "' || geometry_cache_key || '" + '","parameters":{"temporal_resolution":"daily"}')} AS vase_cache_key,
      {_sha('events', '"climate_cache_key":"' + "' || climate_cache_key || '" + '","method":"pilot_manifest_only","parameters":{"sample_note":"full_population"}')} AS event_cache_key FROM c)
    SELECT fire_id, geometry_cache_key, climate_cache_key, event_cache_key, vase_cache_key, {_sha('render', '"parameters":{},"vase_cache_key":"' + "' || vase_cache_key || '" + '"', '"asset_type":"png","fire_id":"' + "' || fire_id || '" + '"')} AS render_cache_key FROM v""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("fire_id"), F.col("c_name").alias("source_geometry_hash"))
    return G.key_chain(c, versions=VERSIONS, variables=["vpd", "tmmx"]).drop("source_geometry_hash")


@query(
    "invalidated_components",
    "12.04",
    """WITH m AS (SELECT user_id, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 4 WHEN 'purchase' THEN 6 ELSE 7 END AS i FROM events), f AS (SELECT user_id, min(i) AS i FROM m GROUP BY 1)
    SELECT user_id, array_to_string((['source', 'geometry', 'climate', 'events', 'traits', 'vase', 'render'])[i:7], ',') AS rebuild FROM f""",
)
def _(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "click", "traits").when(F.col("event_type") == "view", "events").when(F.col("event_type") == "purchase", "vase").otherwise("render")
    return G.invalidated_by(e.withColumn("component", name), "user_id", "component")


def _manifest(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").cast("string").alias("fire_id"), F.lit("run-1").alias("run_id"), status.alias("status"), F.lit(0).alias("attempts"), F.when(status == "failed", "timeout").alias("failure_reason"), "o_orderkey", "o_orderpriority")


def _changes(spark, d):
    m = _manifest(spark, d)
    new = F.when(F.col("o_orderkey") % 4 == 0, "running").when(F.col("o_orderkey") % 4 == 1, "pending").when(F.col("o_orderkey") % 4 == 2, "failed")
    return m.select("fire_id", "run_id", new.alias("new_status"), F.concat(F.lit("stage "), "o_orderpriority").alias("failure_reason")).where("new_status is not null")


_MAN = """m AS (SELECT CAST(o_orderkey AS VARCHAR) AS fire_id, 'run-1' AS run_id, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'failed' END AS st, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END AS nw, 'stage ' || o_orderpriority AS rs FROM orders),
    k AS (SELECT *, coalesce((st = 'pending' AND nw IN ('running', 'failed')) OR (st = 'running' AND nw = 'failed') OR (st = 'failed' AND nw = 'pending'), false) AS ok FROM m)"""


@query(
    "manifest_transitions",
    "12.05",
    f"""WITH {_MAN} SELECT fire_id, run_id, CASE WHEN ok THEN nw ELSE st END AS status, CASE WHEN ok AND st = 'pending' AND nw = 'running' THEN 1 ELSE 0 END AS attempts, CASE WHEN ok THEN CASE WHEN nw = 'failed' THEN rs END ELSE CASE WHEN st = 'failed' THEN 'timeout' END END AS failure_reason FROM k""",
)
def _(spark, d):
    return G.apply_transitions(_manifest(spark, d), _changes(spark, d))[0]


@query("rejected_transitions", "12.05", f"WITH {_MAN} SELECT fire_id, run_id, st AS status, nw AS new_status FROM k WHERE nw IS NOT NULL AND NOT ok")
def _(spark, d):
    return G.apply_transitions(_manifest(spark, d), _changes(spark, d))[1]


@query("retried_manifest", "12.05", f"WITH {_MAN} SELECT fire_id, CASE WHEN st = 'failed' THEN 'pending' ELSE st END AS status, NULL::VARCHAR AS failure_reason FROM k")
def _(spark, d):
    return G.retry_failed(_manifest(spark, d)).select("fire_id", "status", "failure_reason")


def _coverage(spark, d):
    return J.coverage_sets(slices(spark, d), "fire_id", F.col("climate_available"), F.col("year") <= 2000)


_COV = f"""{SLICES}, cv AS (SELECT fire_id, CASE WHEN bool_and(climate_available AND year <= 2000) THEN 'complete' WHEN bool_or(year > 2000) THEN 'unsupported' ELSE 'incomplete' END AS coverage FROM slices GROUP BY 1)"""


@query("climate_complete_manifest", "12.06", f"WITH {_COV} SELECT fire_id, 'run-9' AS run_id, 'climate_complete' AS status FROM cv WHERE coverage = 'complete'")
def _(spark, d):
    m = places(spark, d).select("fire_id", F.lit("run-1").alias("run_id"), F.lit("geometry_complete").alias("status"))
    return G.build_manifest(m, _coverage(spark, d), "run-9", "2024-01-01T00:00:00+00:00")[0].select("fire_id", "run_id", "status")


@query(
    "climate_failures",
    "12.06 7.01",
    f"""WITH {_COV} SELECT fire_id, 'climate' AS stage, true AS retryable, CASE coverage WHEN 'unsupported' THEN 'climate_year_not_cached' ELSE 'outside_gridmet_coverage_or_missing_value' END AS missing_reason FROM cv WHERE coverage <> 'complete'""",
)
def _(spark, d):
    m = places(spark, d).select("fire_id", F.lit("run-1").alias("run_id"), F.lit("geometry_complete").alias("status"))
    bad = G.build_manifest(m, _coverage(spark, d), "run-9", "2024-01-01T00:00:00+00:00")[1]
    return bad.select("fire_id", "stage", "retryable", F.col("context")["missing_reason"].alias("missing_reason"))


def _source(spark, d):
    t = traits(spark, d)
    return t.select("fire_id", "year", "lon", "lat", F.col("total_area_km2").alias("final_area_km2"), (F.col("duration_hours") / 24).alias("duration_days"), F.concat(F.lit("h"), "fire_id").alias("source_geometry_hash"))


@query(
    "built_traits",
    "12.07",
    f"""WITH {TRAITS} SELECT fire_id, year, region, total_area_km2, duration_hours, round(total_area_km2 / duration_hours, 8) AS peak_growth_km2_per_hour, 't1' AS trait_version FROM traits""",
)
def _(spark, d):
    t = G.build_catalog_and_traits(_source(spark, d), versions=VERSIONS, processing_version="p1", run_id="run-1")["fire_traits"]
    assert not G.validate_table(t, G.SCHEMAS["fire_traits"])
    out = t.select("fire_id", "year", "region", "total_area_km2", "duration_hours", "peak_growth_km2_per_hour", "trait_version")
    return rounded(out, "peak_growth_km2_per_hour", digits=8)


@query(
    "built_catalog",
    "12.07",
    f"""WITH {TRAITS} SELECT fire_id, year, region, 'geometry_complete' AS latest_manifest_status, 'geometry:' || substr(sha256('{{"component":"geometry","identity":{{"fire_id":"' || fire_id || '"}},"inputs":{{"method":"canonical_fire_time_geometry","source_geometry_hash":"h' || fire_id || '"}},"versions":{{"geometry":"g1"}}}}'), 1, 24) AS geometry_cache_key FROM traits""",
)
def _(spark, d):
    t = G.build_catalog_and_traits(_source(spark, d), versions=VERSIONS, processing_version="p1", run_id="run-1")["fire_catalog"]
    return t.select("fire_id", "year", "region", "latest_manifest_status", "geometry_cache_key")


@query("climate_table_build", "12.08")
def _(spark, d):
    m = places(spark, d).select("fire_id", F.lit("run-1").alias("run_id"), F.lit("geometry_complete").alias("status"))
    return G.climate_table_job(slices(spark, d), _coverage(spark, d), m, run_id="run-9", now="2024-01-01T00:00:00+00:00", processing_version="p1")


@query("perimeter_exposure_build", "12.08 10.17")
def _(spark, d):
    zones = H.exposure_areas(perimeters(spark, d).select("fire_id", "date", "ring"), [5000.0], cell=5000.0)
    return G.perimeter_climate_job(zones, processing_version="p1")


@query("inventory_kinds", "1.20")
def _(spark, d):
    return T.file_inventory(spark, d, "*.parquet", checksums=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"))


