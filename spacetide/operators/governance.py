"""Lakehouse governance: schema checks, QC flags, keys, invalidation, manifest transitions, table builds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing as H
from ..session import scratch_path
from ..sources import tables as T

# Component order and what each change invalidates: fixed values of the lake's contract.
COMPONENTS = ("source", "geometry", "climate", "events", "traits", "vase", "render")

# Manifest state graph: fixed values.
TRANSITIONS = {
    "pending": ("running", "failed"),
    "running": ("geometry_complete", "failed"),
    "geometry_complete": ("climate_complete", "failed"),
    "climate_complete": ("events_complete", "traits_complete", "failed"),
    "events_complete": ("traits_complete", "failed"),
    "traits_complete": ("assets_complete", "validated", "failed"),
    "assets_complete": ("validated", "failed"),
    "validated": ("published", "failed"),
    "published": (),
    "failed": ("pending",),
}

# Key and required columns of the lake tables with their types: fixed values of the schemas.
SCHEMAS: dict[str, dict] = {
    "fire_catalog": {
        "required": ["fire_id", "catalog_version", "year", "region", "processing_version"],
        "columns": {"fire_id": "string", "catalog_version": "string", "year": "integer", "region": "string", "processing_version": "string", "latest_manifest_status": "string"},
    },
    "fire_traits": {
        "required": ["fire_id", "trait_version", "processing_version", "year", "region"],
        "columns": {"fire_id": "string", "trait_version": "string", "processing_version": "string", "year": "integer", "region": "string", "total_area_km2": "number", "duration_hours": "number", "peak_growth_km2_per_hour": "number"},
    },
    "fire_time": {
        "required": ["fire_id", "time_index", "timestamp", "processing_version"],
        "columns": {"fire_id": "string", "time_index": "integer", "timestamp": "string", "year": "integer", "active_area_km2": "number", "cumulative_area_km2": "number"},
    },
    "processing_manifest": {
        "required": ["fire_id", "run_id", "status"],
        "columns": {"fire_id": "string", "run_id": "string", "status": "string", "component_versions": "object", "attempts": "integer", "failure_reason": "string", "updated_at": "string"},
    },
    "processing_failures": {
        "required": ["run_id", "fire_id", "failed_at", "stage", "message"],
        "columns": {"run_id": "string", "fire_id": "string", "failed_at": "string", "stage": "string", "message": "string", "retryable": "boolean", "context": "object"},
    },
}

_VARIANT_TYPES = {  # prefixes of schema_of_variant that satisfy a declared type
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def validate_json(df: DataFrame, json: str, schema: Mapping) -> DataFrame:
    """Add ``errors``: missing required columns and type mismatches of each JSON row.

    Unknown columns are ignored and null passes every type; an integer is not a boolean.
    """
    kinds = schema["columns"]
    names = list(dict.fromkeys([*schema["required"], *kinds]))
    parsed = df.withColumn("_v", F.try_parse_json(json))
    parsed = parsed.withColumns({f"_t_{c}": F.schema_of_variant(F.try_variant_get("_v", f"$.{c}", "variant")) for c in names})
    errors = []
    for c in sorted(schema["required"]):
        errors.append(F.when(F.col(f"_t_{c}").isNull(), F.lit(f"missing required column {c!r}")))
    for c, kind in kinds.items():
        t = F.col(f"_t_{c}")
        allowed = _VARIANT_TYPES.get(kind)
        if allowed is None:
            continue
        fits = t == "VOID"
        for prefix in allowed:
            fits = fits | t.startswith(prefix)
        errors.append(F.when(t.isNotNull() & ~fits, F.lit(f"column {c!r} expected {kind}")))
    out = parsed.withColumn("errors", F.array_compact(F.array(*errors)))
    return out.drop("_v", *[f"_t_{c}" for c in names])


def validate_table(df: DataFrame, schema: Mapping) -> list[str]:
    """Schema-level check of a typed table before anything runs: missing columns and wrong types."""
    have = dict(df.dtypes)
    ok = {
        "string": ("string",), "integer": ("bigint", "int", "smallint", "tinyint"), "boolean": ("boolean",), "object": ("map", "struct"), "array": ("array",),
        "number": ("bigint", "int", "smallint", "tinyint", "double", "float", "decimal"),
    }
    errors = [f"missing required column {c!r}" for c in sorted(schema["required"]) if c not in have]
    for c, kind in schema["columns"].items():
        if c in have and kind in ok and not have[c].startswith(ok[kind]):
            errors.append(f"column {c!r} expected {kind}, got {have[c]}")
    return errors


def geometry_qc(area: Column, is_valid: Column, is_empty: Column, newly_added: Column) -> Column:
    return F.array_compact(F.array(
        F.when(is_empty, "empty_geometry"), F.when(~is_valid, "invalid_geometry"),
        F.when(area.isNull() | (area <= 0), "nonpositive_area"), F.when(newly_added, "newly_added_geometry"),
    ))


def climate_qc(observed: Column, expected: Column, variable: Column) -> Column:
    missing = F.round(1 - C.ratio(observed, expected), 12)
    flag = (
        F.when(expected <= 0, F.lit("invalid_expected_steps")).when(missing > 0.05, F.concat(variable, F.lit("_missing_gt_5pct")))
        .when(missing > 0, F.concat(variable, F.lit("_missing_le_5pct")))
    )
    return F.array_compact(F.array(flag))


def climate_passed(flags: Column) -> Column:
    return ~F.exists(flags, lambda f: f.endswith("gt_5pct"))


def key_chain(df: DataFrame, *, versions: Mapping[str, str], variables: Sequence[str], source: str = "gridmet", resolution: str = "daily") -> DataFrame:
    """geometry, climate, events, vase and render keys, each hashed over its parent's key."""
    params = {"temporal_resolution": resolution}
    step = df.withColumn("geometry_cache_key", H.geometry_key(F.col("fire_id"), F.col("source_geometry_hash"), versions["geometry"]))
    step = step.withColumn("climate_cache_key", H.climate_key(F.col("fire_id"), F.col("geometry_cache_key"), source, variables, resolution, versions["climate"]))
    step = step.withColumns(
        {
            "event_cache_key": H.event_key(F.col("fire_id"), F.col("climate_cache_key"), versions["events"], "pilot_manifest_only", {"sample_note": "full_population"}),
            "vase_cache_key": H.vase_key(F.col("fire_id"), F.col("geometry_cache_key"), F.col("climate_cache_key"), versions["vase"], params),
        }
    )
    return step.withColumn("render_cache_key", H.render_key(F.col("fire_id"), F.col("vase_cache_key"), versions["render"], "png"))


def invalidated(changed: Sequence[str]) -> list[str]:
    """Components to rebuild after changes, in build order; an unknown one is an error."""
    unknown = [c for c in changed if c not in COMPONENTS]
    if unknown:
        raise ValueError(f"unknown component {unknown[0]!r}")
    # geometry .. render each invalidate themselves and everything after them
    first = min((COMPONENTS.index(c) for c in changed), default=len(COMPONENTS))
    return list(COMPONENTS[first:])


def invalidated_by(df: DataFrame, key: str, component: str) -> DataFrame:
    """Downstream components per key as a comma list, from a table of changes."""
    order = F.array(*[F.lit(c) for c in COMPONENTS])
    at = F.array_position(order, F.col(component))
    checked = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown component "), F.col(component))).cast("bigint"))
    first = df.groupBy(key).agg(F.min(checked).cast("int").alias("_i"))
    return first.select(key, F.concat_ws(",", F.slice(order, F.col("_i"), F.lit(len(COMPONENTS)))).alias("rebuild"))


def _allowed() -> Column:
    return F.create_map(*[c for old, news in TRANSITIONS.items() for c in (F.lit(old), F.array(*[F.lit(n) for n in news]).cast("array<string>"))])


def apply_transitions(manifest: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated manifest, rejected changes). One change per (fire_id, run_id).

    Attempts grow by one from pending to running; a reason survives only on failed.
    """
    c = changes.select("fire_id", "run_id", "new_status", F.col("failure_reason").alias("_reason"))
    joined = manifest.join(c, ["fire_id", "run_id"], "left")
    new, old = F.col("new_status"), F.col("status")
    ok = C.is_true(F.array_contains(_allowed()[old], new))
    bad = joined.where(new.isNotNull() & ~ok).select("fire_id", "run_id", "status", "new_status")
    start = (old == "pending") & (new == "running")
    updated = joined.select(
        "fire_id", "run_id", F.when(ok, new).otherwise(old).alias("status"),
        F.when(ok & start, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(ok, F.when(new == "failed", F.col("_reason"))).otherwise(F.col("failure_reason")).alias("failure_reason"),
    )
    return updated, bad


def retry_failed(manifest: DataFrame) -> DataFrame:
    """Failed records back to pending, others unchanged."""
    failed = F.col("status") == "failed"
    return manifest.withColumns({"status": F.when(failed, "pending").otherwise(F.col("status")), "failure_reason": F.when(~failed, F.col("failure_reason"))})


FAILURES = {  # coverage class -> message and machine-readable reason: fixed texts
    "unsupported": ("No cached gridMET daily file for one or more fire slice years.", "climate_year_not_cached"),
    "incomplete": ("Cached gridMET extraction returned missing values for one or more fire slices.", "outside_gridmet_coverage_or_missing_value"),
}


def build_manifest(manifest: DataFrame, coverage: DataFrame, run_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Climate-complete manifest rows and retryable failures, from the coverage class of each event."""
    done = manifest.join(coverage.where("coverage = 'complete'").select("fire_id"), "fire_id", "left_semi")
    done = done.withColumns({"status": F.lit("climate_complete"), "run_id": F.lit(run_id), "updated_at": F.lit(now)})
    pick = lambda i: F.create_map(*[F.lit(v) for k, t in FAILURES.items() for v in (k, t[i])])[F.col("coverage")]
    failures = coverage.where(F.col("coverage").isin(*FAILURES)).select(
        F.lit(run_id).alias("run_id"), "fire_id", F.lit(now).alias("failed_at"), F.lit("climate").alias("stage"), pick(0).alias("message"),
        F.lit(True).alias("retryable"), F.create_map(F.lit("missing_reason"), pick(1)).alias("context"),
    )
    return done, failures


def build_catalog_and_traits(source: DataFrame, *, versions: Mapping[str, str], processing_version: str, run_id: str) -> dict[str, DataFrame]:
    """Catalog, traits, manifest and sample records, all projections of one source scan.

    ``source``: fire_id, year, lon, lat, final_area_km2, duration_days, source_geometry_hash.
    The trait peak growth is the mean rate total / duration, as published.
    """
    base = key_chain(source.withColumn("region", C.region_of("lon", "lat")), versions=versions, variables=["tmmx", "tmmn", "vpd", "vs"])
    hours = F.col("duration_days") * 24.0
    return {
        "fire_catalog": base.select(
            "fire_id", F.lit("pilot").alias("catalog_version"), "year", "region", F.lit(processing_version).alias("processing_version"),
            F.lit("geometry_complete").alias("latest_manifest_status"), "geometry_cache_key", "climate_cache_key", "vase_cache_key",
        ),
        "fire_traits": base.select(
            "fire_id", F.lit(versions["traits"]).alias("trait_version"), F.lit(processing_version).alias("processing_version"), "year", "region",
            F.col("final_area_km2").alias("total_area_km2"), hours.alias("duration_hours"), F.coalesce(C.ratio(F.col("final_area_km2"), hours), F.lit(0.0)).alias("peak_growth_km2_per_hour"),
            "geometry_cache_key", "climate_cache_key", "event_cache_key",
        ),
        "processing_manifest": base.select("fire_id", F.lit(run_id).alias("run_id"), F.lit("geometry_complete").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("failure_reason")),
        "sample_records": base.select("fire_id", "year", "region", "source_geometry_hash"),
    }


def write_tables(tables: Mapping[str, DataFrame], root: str | None = None) -> dict[str, str]:
    spark = next(iter(tables.values())).sparkSession
    root = root or scratch_path(spark, "lake")
    return {name: T.write_table(df, root, name) for name, df in tables.items()}


def climate_table_job(slices: DataFrame, coverage: DataFrame, manifest: DataFrame, *, run_id: str, now: str, processing_version: str, root: str | None = None) -> DataFrame:
    """Write the climate slice table, manifest and failures; return a report of row counts read back from disk."""
    done, failures = build_manifest(manifest, coverage, run_id, now)
    rows = slices.join(coverage.where("coverage <> 'unsupported'").select("fire_id"), "fire_id", "left_semi")
    rows = rows.withColumns({"processing_version": F.lit(processing_version), "region": C.region_of("lon", "lat"), "spatial_bucket": C.spatial_bucket("lon", "lat", 10.0)})
    tag = lambda df: df.withColumn("processing_version", F.lit(processing_version))
    paths = write_tables({"vase_slices": rows, "processing_manifest": tag(done), "processing_failures": tag(failures)}, root)
    return _report(slices, paths)


def perimeter_climate_job(exposure: DataFrame, *, processing_version: str, root: str | None = None) -> DataFrame:
    """Write the exposure table and report its rows."""
    out = exposure.withColumns({"processing_version": F.lit(processing_version), "year": F.year("date")})
    return _report(exposure, write_tables({"vase_climate_exposures": out}, root))


def _report(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    spark = df.sparkSession
    report = None
    for name, path in paths.items():
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("fire_id").alias("n_fires")).withColumn("table", F.lit(name))
        report = part if report is None else report.unionByName(part)
    return report.select("table", "n_rows", "n_fires")
