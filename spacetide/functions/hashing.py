"""Canonical JSON, content hashes and chained component keys, computed in the plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = "Column | Mapping | Sequence | str | int | float | bool | None"


def _node(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, Mapping):
        if not value:
            return F.create_map().cast("map<string,string>")
        return F.struct(*[_node(value[k]).alias(str(k)) for k in sorted(value, key=str)])
    if isinstance(value, (list, tuple)):
        if not value:
            return F.array().cast("array<string>")
        return F.array(*[_node(v) for v in value])
    return F.lit(value)


def canonical_json(value) -> Column:
    """JSON text with sorted keys and compact separators. Columns may sit anywhere inside."""
    return F.to_json(_node(value), {"ignoreNullFields": "false"})


def canonical_map(m: Column) -> Column:
    """A map column with its entries in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def content_hash(value, length: int = 16) -> Column:
    text = value if isinstance(value, Column) else canonical_json(value)
    return F.substring(F.sha2(text, 256), 1, length)


def component_key(component: str, *, identity, versions, inputs) -> Column:
    payload = {
        "component": component,
        "identity": identity,
        "versions": versions,
        "inputs": inputs,
    }
    return F.concat(F.lit(f"{component}:"), content_hash(payload, 24))


def geometry_key(fire_id: Column, source_hash: Column, version: str, method: str = "canonical_fire_time_geometry") -> Column:
    return component_key(
        "geometry",
        identity={"fire_id": fire_id},
        versions={"geometry": version},
        inputs={"method": method, "source_geometry_hash": source_hash},
    )


def climate_key(fire_id: Column, geometry: Column, source: str, variables: Sequence[str], resolution: str, version: str) -> Column:
    return component_key(
        "climate",
        identity={"fire_id": fire_id},
        versions={"climate": version},
        inputs={
            "climate_source": source,
            "geometry_cache_key": geometry,
            "temporal_resolution": resolution,
            "variables": sorted(variables),
        },
    )


def event_key(fire_id: Column, climate: Column, version: str, method: str, parameters: Mapping) -> Column:
    return component_key(
        "events",
        identity={"fire_id": fire_id},
        versions={"events": version},
        inputs={"climate_cache_key": climate, "method": method, "parameters": parameters},
    )


def vase_key(fire_id: Column, geometry: Column, climate: Column, version: str, parameters: Mapping) -> Column:
    return component_key(
        "vase",
        identity={"fire_id": fire_id},
        versions={"vase": version},
        inputs={
            "climate_cache_key": climate,
            "geometry_cache_key": geometry,
            "parameters": parameters,
        },
    )


def render_key(fire_id: Column, vase: Column, version: str, asset_type: str, parameters: Mapping | None = None) -> Column:
    return component_key(
        "render",
        identity={"asset_type": asset_type, "fire_id": fire_id},
        versions={"render": version},
        inputs={"parameters": parameters or {}, "vase_cache_key": vase},
    )


def hash_order(*parts: Column | str) -> Column:
    """Reproducible pseudo-random sort key (hex text) for sampling and folds."""
    return F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def hash_uniform(*parts: Column | str) -> Column:
    """Reproducible uniform number in (0, 1) from a 52-bit slice of the hash."""
    head = F.conv(F.substring(hash_order(*parts), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def hash_bucket(k: int, *parts: Column | str) -> Column:
    head = F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(k)).cast("int")
