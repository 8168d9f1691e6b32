"""Reading gridded cubes from landed tables, and everything done while reading."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CELL, null_missing

# --- areas of interest -------------------------------------------------------


#: Fixed value: degrees around a point.
POINT_BUFFER = 0.05


def aoi_box(*, point=None, bbox=None, geojson=None) -> tuple[float, float, float, float]:
    """One AOI as (min_lon, min_lat, max_lon, max_lat); exactly one form must be given.

    A point is widened by ``POINT_BUFFER`` degrees on each side; a box whose minimum is not below its maximum is refused.
    """
    given = [v is not None for v in (point, bbox, geojson)]
    if sum(given) != 1:
        raise ValueError("give exactly one of point, bbox, geojson")
    if point is not None:
        lon, lat = point
        return lon - POINT_BUFFER, lat - POINT_BUFFER, lon + POINT_BUFFER, lat + POINT_BUFFER
    if bbox is not None:
        x0, y0, x1, y1 = map(float, bbox)
        if x0 >= x1 or y0 >= y1:
            raise ValueError("bbox minima must be below its maxima")
        return x0, y0, x1, y1
    shape = json.loads(geojson) if isinstance(geojson, str) else geojson
    flat: list[tuple[float, float]] = []

    def walk(node) -> None:
        if isinstance(node, (list, tuple)):
            if node and isinstance(node[0], (int, float)):
                flat.append((float(node[0]), float(node[1])))
            else:
                for child in node:
                    walk(child)

    if shape.get("type") == "FeatureCollection":
        for feature in shape["features"]:
            walk(feature["geometry"]["coordinates"])
    else:
        walk(shape.get("geometry", shape)["coordinates"])
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    return min(xs), min(ys), max(xs), max(ys)


def aoi_bounds(df: DataFrame, key: str, geojson: str | Column) -> DataFrame:
    """Bounds of many AOIs at once from a GeoJSON text column.

    Any nesting of ``coordinates`` ends in number pairs, so the pairs are read
    from the text itself; no per-shape schema is needed.
    """
    text = C.as_col(geojson)
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    pair = rf"\[\s*({number})\s*,\s*({number})"
    axis = lambda g: F.transform(
        F.regexp_extract_all(text, F.lit(pair), g), lambda v: v.cast("double")
    )
    return df.select(
        key,
        F.array_min(axis(1)).alias("min_lon"),
        F.array_min(axis(2)).alias("min_lat"),
        F.array_max(axis(1)).alias("max_lon"),
        F.array_max(axis(2)).alias("max_lat"),
    )


def bbox_center(df: DataFrame, edge: float, metres_per_degree: float = 111000.0) -> DataFrame:
    """Centre and edge length: the larger of ``edge`` and the span in metres."""
    span = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    return df.withColumns(
        {
            "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
            "edge_size": F.greatest(F.lit(float(edge)), F.floor(span * metres_per_degree).cast("double")),
        }
    )


# --- reading -----------------------------------------------------------------

DIM_ALIASES = {  # fixed names under which grids arrive
    "lat": ["lat", "latitude"],
    "lon": ["lon", "longitude", "lng"],
    "time": ["time", "day", "date", "datetime"],
}


def normalize_dims(df: DataFrame, *, wrap: bool = False) -> DataFrame:
    """Canonical lat / lon / time names; ``wrap`` maps longitudes to 0..360."""
    lower = {c.lower(): c for c in df.columns}
    for name, names in DIM_ALIASES.items():
        found = next((lower[n] for n in names if n in lower), None)
        if found is not None and found != name:
            df = df.withColumnRenamed(found, name)
    return df.withColumn("lon", F.pmod(F.col("lon"), F.lit(360.0))) if wrap else df


def wrap_box(box, *, grid_0_360: bool):
    """AOI box on a 0..360 grid; a box across the dateline is refused."""
    x0, y0, x1, y1 = box
    if grid_0_360:
        x0, x1 = (x0 % 360 if x0 < 0 else x0), (x1 % 360 if x1 < 0 else x1)
    if x0 > x1:
        raise ValueError("the area crosses the dateline; split it")
    return x0, y0, x1, y1


def select_cube(df: DataFrame, *, variables: Sequence[str] | None = None, box=None, start=None, end=None) -> DataFrame:
    """Inclusive time range, box and variables, as plain predicates on the scan columns."""
    if variables is not None:
        df = df.where(F.col("variable").isin(*variables))
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start).cast(dict(df.dtypes)["time"]))
    if end is not None:
        df = df.where(F.col("time") <= F.lit(end).cast(dict(df.dtypes)["time"]))
    if box is not None:
        x0, y0, x1, y1 = box
        df = df.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    return df


def read_cube(spark: SparkSession, root: str, *, variables=None, start=None, end=None, point=None, bbox=None, geojson=None) -> DataFrame:
    """A landed cube (partitioned by variable / year) restricted before any row is read."""
    df = normalize_dims(spark.read.parquet(root))
    box = aoi_box(point=point, bbox=bbox, geojson=geojson) if any(v is not None for v in (point, bbox, geojson)) else None
    if "year" in df.columns and start is not None:
        df = df.where(F.col("year") >= int(str(start)[:4]))
    if "year" in df.columns and end is not None:
        df = df.where(F.col("year") <= int(str(end)[:4]))
    return null_missing(select_cube(df, variables=variables, box=box, start=start, end=end), "value")


def write_cube(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Land a cube partitioned by variable and year, sorted so row groups prune by time and place."""
    out = df.withColumn("year", F.year("time")).hint("rebalance", "variable", "year")
    out.sortWithinPartitions("variable", "year", "time", "lat", "lon").write.mode(mode).partitionBy("variable", "year").parquet(root)


def require_data(df: DataFrame, value: str = "value") -> DataFrame:
    """The cube itself, or an error when it has no rows or no present value."""
    if df.where(F.col(value).isNotNull()).limit(1).count() == 0:  # stops at the first hit
        raise ValueError("the cube is empty or entirely missing")
    return df


def data_probe(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """rows / present counts and the verdict, per group."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_present"),
        (F.count(value) > 0).alias("usable"),
    )


# --- shaping while reading ---------------------------------------------------


def resample_time(cube: DataFrame, freq: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean per calendar period; periods without data become NULL rows."""
    period = F.date_trunc(freq, F.col("time")).cast("date")
    means = cube.groupBy(*keys, period.alias("time")).agg(F.avg("value").alias("value"))
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[freq.lower()]
    bounds = cube.agg(F.struct(F.min(period).alias("lo"), F.max(period).alias("hi")).alias("b")).scalar()
    cells = cube.select(*keys).distinct().withColumn("_b", bounds)
    frame = cells.select(*keys, F.explode(F.expr(f"sequence(_b.lo, _b.hi, {step})")).alias("time"))
    return frame.join(means, [*keys, "time"], "left")


# Semantic names per source: fixed values of the two catalogues.
TEMPERATURE_CODES = {
    "gridmet": {"temperature": "tmmx", "temperature_min": "tmmn", "temperature_max": "tmmx"},
    "prism": {"temperature": "tmean", "temperature_min": "tmin", "temperature_max": "tmax"},
}


def semantic_variable(kind: str, source: str) -> str:
    """Code of a semantic name. The first catalogue has no daily mean, so its mean is the maximum."""
    if source not in TEMPERATURE_CODES:
        raise ValueError(f"unknown source {source!r}, expected one of {sorted(TEMPERATURE_CODES)}")
    codes = TEMPERATURE_CODES[source]
    if kind not in codes:
        raise ValueError(f"unknown kind {kind!r}, expected one of {sorted(codes)}")
    return codes[kind]


def semantic_cube(cube: DataFrame, kind: str, source: str) -> DataFrame:
    return cube.where(F.col("variable") == semantic_variable(kind, source))


def year_chunks(df: DataFrame, start, end, years: int = 1) -> DataFrame:
    """Tag rows of one pruned scan with their calendar-year chunk, clamped at both ends."""
    if years < 1:
        raise ValueError("years must be at least 1")
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    day = F.col("time").cast("date")
    first = F.year(lo) + F.floor((F.year(day) - F.year(lo)) / years).cast("int") * years
    return (
        df.where(day.between(lo, hi))
        .withColumn("chunk_start", F.greatest(lo, F.make_date(first, F.lit(1), F.lit(1))))
        .withColumn("chunk_end", F.least(hi, F.make_date(first + (years - 1), F.lit(12), F.lit(31))))
    )


def assign_tiles(df: DataFrame, *, box, dlon: float = 2.0, dlat: float = 2.0, time_freq: str = "year", lon="lon", lat="lat", time="time") -> DataFrame:
    """Half-open space and time tiles as columns; the far edge joins the last tile."""
    x0, y0, x1, y1 = box
    inside = F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)

    def part(c: str, lo: float, hi: float, step: float) -> Column:
        n = max(1, -int(-(hi - lo) // step))
        return F.least(F.floor((F.col(c) - lo) / step), F.lit(n - 1)).cast("int")

    return df.where(inside).withColumns(
        {
            "tile_x": part(lon, x0, x1, dlon),
            "tile_y": part(lat, y0, y1, dlat),
            "tile_t": F.date_trunc(time_freq, F.col(time)).cast("date"),
        }
    )


def combine_tiles(*tiles: DataFrame, keys: Sequence[str] = ("time", *CELL)) -> DataFrame:
    """Tiles back to one cube; a cell that several tiles carry is kept once."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    names = [r[0] for r in out.select("variable").distinct().limit(2).collect()] if "variable" in out.columns else []
    if len(names) > 1:
        raise ValueError("tiles hold more than one variable")
    return out.dropDuplicates(list(keys))


def cube_for_events(events: DataFrame, cube: DataFrame, *, buffer_days: int, reach: float) -> DataFrame:
    """Cube rows around every event: |dx|, |dy| <= reach and the day in [t0 - b, t1 + b].

    Both sides meet on integer tiles of size ``reach``; an event visits its own
    and the eight neighbouring tiles, so no event scans the whole cube.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    wanted = (
        events.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .select("event_id", "t0", "t1", F.col("lon").alias("_elon"), F.col("lat").alias("_elat"),
                (tile("lon") + F.col("_dx")).alias("_tx"), (tile("lat") + F.col("_dy")).alias("_ty"))
    )
    near = (F.abs(F.col("lon") - F.col("_elon")) <= reach) & (F.abs(F.col("lat") - F.col("_elat")) <= reach)
    when = F.col("time").between(F.date_sub("t0", buffer_days), F.date_add("t1", buffer_days))
    tiled = cube.withColumns({"_tx": tile("lon"), "_ty": tile("lat")})
    return tiled.join(wanted, ["_tx", "_ty"]).where(near & when).select("event_id", "time", "lon", "lat", "value")


KELVIN = ("tmmx", "tmmn")


def convert_units(df: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Kelvin to Celsius for the two temperature codes, other variables unchanged."""
    c = F.col(value)
    return df.withColumn(value, F.when(F.col(variable).isin(*KELVIN), c - 273.15).otherwise(c))


def guarded_kelvin(df: DataFrame, variable: str = "variable", value: str = "value", floor: float = 150.0) -> DataFrame:
    """:func:`convert_units`, refusing values whose median cannot be Kelvin (one-row probe)."""
    from ..functions.ranking import quantiles

    median = quantiles(df.where(F.col(variable).isin(*KELVIN)), value, [0.5])[0]
    if median is not None and median < floor:
        raise ValueError("values do not look like Kelvin; refusing to convert")
    return convert_units(df, variable, value)


# Words that identify a variable inside file metadata: fixed values of the catalogue.
VARIABLE_TOKENS = {
    "tmmx": ("air_temperature", "maximum_temperature"),
    "tmmn": ("air_temperature", "minimum_temperature"),
    "vpd": ("mean_vapor_pressure_deficit", "vapor_pressure_deficit"),
    "vs": ("wind_speed",),
    "pr": ("precipitation",),
    "rmax": ("maximum_relative_humidity", "relative_humidity"),
    "rmin": ("minimum_relative_humidity", "relative_humidity"),
    "sph": ("specific_humidity",),
    "fm100": ("100-hour_dead_fuel_moisture", "fuel_moisture"),
    "fm1000": ("1000-hour_dead_fuel_moisture", "fuel_moisture"),
    "erc": ("energy_release_component",),
    "bi": ("burning_index",),
    "etr": ("reference_evapotranspiration",),
    "pet": ("potential_evapotranspiration",),
    "srad": ("surface_downwelling_shortwave_flux", "solar_radiation"),
}


def resolve_variable(df: DataFrame, code: str, *, coordinates: Sequence[str] = ("time", "lat", "lon"), tokens: Mapping[str, Sequence[str]] = VARIABLE_TOKENS) -> str:
    """Data column for a code: exact name, the only column, else a word match on name and metadata."""
    names = [c for c in df.columns if c not in coordinates]
    if code in names:
        return code
    if len(names) == 1:
        return names[0]
    for name in names:
        text = " ".join([name, *map(str, df.schema[name].metadata.values())]).lower()
        if any(t in text for t in tokens.get(code, ())):
            return name
    raise KeyError(f"no column for {code!r} among {names}")


def drop_bad_slices(cube: DataFrame, probe: Column) -> DataFrame:
    """Drop time slices whose probe cell is unreadable; an error when none is left."""
    good = cube.groupBy("time").agg(F.max(F.when(probe, F.col("value"))).alias("_p")).where(F.col("_p").isNotNull())
    if good.limit(1).count() == 0:
        raise ValueError("every time slice failed the probe")
    return cube.join(good.select("time"), "time", "left_semi")


def attach_provenance(df: DataFrame, *, source: str, freq: str, start=None, end=None, is_synthetic: bool = False, error: str | None = None) -> DataFrame:
    return df.withColumns(
        {
            "source": F.lit(source),
            "is_synthetic": F.lit(is_synthetic),
            "freq": F.lit(freq),
            "requested_start": F.lit(start),
            "requested_end": F.lit(end),
            "backend_error": F.lit(error).cast("string"),
        }
    )
