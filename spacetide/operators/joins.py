"""Spatial and temporal joins: nearest cell, as-of, grid alignment, rasterising, pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ranking import quantile_table
from ..model import CELL
from ..session import cut_lineage
from .neighbors import knn_join

KM_PER_DEGREE = C.EARTH_RADIUS_KM * math.pi / 180


def join_events(daily: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    return daily.join(events, key, "inner")


def fill_from_catalog(df: DataFrame, catalog: DataFrame, key: str, column: str, computed: Column) -> DataFrame:
    """Attach a catalog key; compute it where the catalog has none."""
    got = catalog.select(key, F.col(column).alias("_c"))
    return df.join(got, key, "left").withColumn(column, F.coalesce(F.col("_c"), computed)).drop("_c")


# --- positions on an axis ----------------------------------------------------


def axis_intervals(axis: DataFrame, coord: str, method: str = "nearest") -> DataFrame:
    """For each axis point the interval of values it serves: idx, coord, next, lo, hi.

    nearest: (mid to previous, mid to next], so the first index wins ties;
    pad: [point, next); backfill: (previous, point].
    The axis (rows, columns or days of a grid) is one small sorted array.
    """
    inf = F.lit(float("inf"))
    packed = axis.select(F.col(coord).cast("double").alias("_v")).distinct().agg(F.array_sort(F.collect_set("_v")).alias("_a"))
    rows = packed.select("_a", F.posexplode("_a").alias("idx", "coord"))
    prev, nxt = F.get("_a", F.col("idx") - 1), F.get("_a", F.col("idx") + 1)
    if method == "nearest":
        lo, hi = (prev + F.col("coord")) / 2, (F.col("coord") + nxt) / 2
    elif method == "pad":
        lo, hi = F.col("coord"), nxt
    elif method == "backfill":
        lo, hi = prev, F.col("coord")
    else:
        raise ValueError("method must be nearest, pad or backfill")
    return rows.select("idx", "coord", nxt.alias("next"), F.coalesce(lo, -inf).alias("lo"), F.coalesce(hi, inf).alias("hi"))


def locate(df: DataFrame, value: str | Column, axis: DataFrame, coord: str, name: str, method: str = "nearest", extra: bool = False) -> DataFrame:
    """Attach the axis position serving ``value`` as ``name`` (and ``name_coord``).

    Intervals are spread over equal buckets of the axis range, so the lookup is
    an equi-join plus an interval test whatever the axis spacing.
    """
    served = axis_intervals(axis, coord, method)
    span = served.agg(
        F.struct(F.min("coord").alias("a0"), F.max("coord").alias("a1"), F.count(F.lit(1)).alias("n")).alias("s")
    ).scalar()
    width = F.greatest((F.col("_s.a1") - F.col("_s.a0")) / F.col("_s.n"), F.lit(1e-12))

    def bucket(c: Column) -> Column:
        clipped = F.least(F.greatest(c, F.col("_s.a0")), F.col("_s.a1"))
        return F.floor((clipped - F.col("_s.a0")) / width).cast("bigint")

    right = (
        served.withColumn("_s", span)
        .withColumn("_b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
        .select("_b", "lo", "hi", F.col("idx").alias(name), F.col("coord").alias(f"{name}_coord"), F.col("next").alias(f"{name}_next"))
    )
    left = df.withColumn("_v", C.as_col(value).cast("double")).withColumn("_s", span).withColumn("_b", bucket(F.col("_v"))).drop("_s")
    inside = (
        (F.col("_v") >= F.col("lo")) & (F.col("_v") < F.col("hi"))
        if method == "pad"
        else (F.col("_v") > F.col("lo")) & (F.col("_v") <= F.col("hi"))
    )
    out = left.join(right, "_b", "left" if extra else "inner").where(inside).drop("_b", "_v", "lo", "hi")
    return out if extra else out.drop(f"{name}_next")


def day_number(c: str | Column) -> Column:
    return F.datediff(C.as_col(c), F.lit("1970-01-01").cast("date")).cast("double")


def nearest_cell_join(points: DataFrame, grid: DataFrame, values: Sequence[str], *, lon="lon", lat="lat", time="time") -> DataFrame:
    """Grid values at the nearest longitude, latitude and date of every point."""
    tagged = grid.withColumns({"_gx": F.col(lon).cast("double"), "_gy": F.col(lat).cast("double"), "_gt": day_number(time)})
    out = locate(points, lon, tagged, "_gx", "_ix")
    out = locate(out, lat, tagged, "_gy", "_iy")
    out = locate(out.withColumn("_d", day_number(time)), "_d", tagged, "_gt", "_it").drop("_d")
    cells = tagged.select(
        F.col("_gx").alias("_ix_coord"), F.col("_gy").alias("_iy_coord"), F.col("_gt").alias("_it_coord"), *values
    )
    return out.join(cells, ["_ix_coord", "_iy_coord", "_it_coord"], "left").drop("_ix", "_iy", "_it", "_ix_coord", "_iy_coord", "_it_coord")


def as_of_join(days: DataFrame, states: DataFrame, *, key: str, day: str, date: str, values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Latest state with date <= day; days before the first state are dropped. ``keep``: further columns of ``days``.

    Union and a forward fill: no inequality join. A key holds at most one row
    per day on each side, so a fill partition is bounded by the calendar.
    """
    a = days.select(key, F.col(day).alias("_t"), F.lit(1).alias("_ask"), *[F.lit(None).cast(dict(states.dtypes)[v]).alias(v) for v in values], F.lit(None).cast("date").alias("_since"), *keep)
    b = states.select(key, F.col(date).alias("_t"), F.lit(0).alias("_ask"), *values, F.col(date).alias("_since"), *[F.lit(None).cast(days.schema[c].dataType).alias(c) for c in keep])
    w = W.partitionBy(key).orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    state = F.last(F.when(F.col("_ask") == 0, F.struct("_since", *values)), ignorenulls=True).over(w)
    filled = a.unionByName(b).withColumn("_f", state).where((F.col("_ask") == 1) & F.col("_f").isNotNull())
    return filled.select(key, F.col("_t").alias(day), F.col("_f._since").alias("state_date"), *[F.col(f"_f.{v}").alias(v) for v in values], *keep)


def align_cube(cube: DataFrame, like: DataFrame, *, spatial: str = "nearest", temporal: str = "nearest", tolerance_days: int | None = None) -> DataFrame:
    """Resample a cube (time, y, x, value) to the coordinates of ``like``.

    Outside the source's spatial hull the value is NULL, as it is where the
    nearest time is further than the tolerance.
    """
    if spatial not in {"nearest", "linear"}:
        raise ValueError("spatial must be nearest or linear")
    src = cube.withColumn("_t", day_number("time"))

    def targets(c: str) -> DataFrame:
        want = like.select(c).distinct()
        bounds = src.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b")).scalar()
        want = want.withColumn("_b", bounds).where(F.col(c).between(F.col("_b.lo"), F.col("_b.hi"))).drop("_b")
        if spatial == "nearest":
            return locate(want, c, src, c, "_i").select(c, F.col("_i_coord").alias(f"_{c}"), F.lit(1.0).alias(f"_w{c}"))
        pad = locate(want, c, src, c, "_i", "pad", extra=True)
        frac = F.coalesce(F.try_divide(F.col(c) - F.col("_i_coord"), F.col("_i_next") - F.col("_i_coord")), F.lit(0.0))
        both = F.array(
            F.struct(F.col("_i_coord").alias("p"), (1 - frac).alias("w")), F.struct(F.col("_i_next").alias("p"), frac.alias("w"))
        )
        return pad.select(c, F.explode(both).alias("n")).where("n.w > 0").select(c, F.col("n.p").alias(f"_{c}"), F.col("n.w").alias(f"_w{c}"))

    when = like.select("time").distinct().withColumn("_lt", day_number("time"))
    when = locate(when, "_lt", src, "_t", "_i", temporal)
    if tolerance_days is not None:
        when = when.where(F.abs(F.col("_lt") - F.col("_i_coord")) <= tolerance_days)
    when = when.select("time", F.col("_i_coord").alias("_t"))
    ys, xs = targets("y"), targets("x")
    # the source rows fan out to the few targets each serves
    got = (
        src.select("_t", F.col("y").alias("_y"), F.col("x").alias("_x"), "value")
        .join(ys, "_y").join(xs, "_x").join(when, "_t")
        .groupBy("time", "y", "x")
        .agg(
            F.sum(F.col("value") * F.col("_wy") * F.col("_wx")).alias("_v"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("_wy") * F.col("_wx"))).alias("_w"),
        )
        .select("time", "y", "x", F.when(F.abs(F.col("_w") - 1) < 1e-9, F.col("_v")).alias("value"))
    )
    frame = like.select("time", "y", "x").distinct()
    return frame.join(got, ["time", "y", "x"], "left")


def rasterize_observations(obs: DataFrame, template: DataFrame, *, time="date", y="y", x="x", value="value", reducer: str = "sum") -> DataFrame:
    """Snap observations to the nearest cell of the template; unobserved cells stay NULL."""
    if reducer not in {"sum", "mean", "count"}:
        raise ValueError("reducer must be sum, mean or count")
    aggs = {"sum": F.sum(value), "mean": F.avg(value), "count": F.count(F.lit(1)).cast("double")}
    src = template.withColumn("_tn", day_number("time"))
    # observations are reduced per distinct position before the axis lookups
    out = obs.withColumn("_d", day_number(time))
    out = locate(locate(locate(out, "_d", src, "_tn", "_it"), y, src, "y", "_iy"), x, src, "x", "_ix")
    cells = out.groupBy(F.col("_it_coord").alias("_tn"), F.col("_iy_coord").alias("y"), F.col("_ix_coord").alias("x")).agg(aggs[reducer].alias("value"))
    frame = src.select("time", "_tn", "y", "x").distinct()
    return frame.join(cells, ["_tn", "y", "x"], "left").drop("_tn")


def align_join(left: DataFrame, right: DataFrame, on: str = "time", how: str = "inner") -> DataFrame:
    """Inner / outer / left / exact alignment of two series; exact refuses a mismatch."""
    if how == "exact":
        probe = left.select(on).join(right.select(on), on, "left_anti").limit(1).count()
        probe += right.select(on).join(left.select(on), on, "left_anti").limit(1).count()
        if probe:
            raise ValueError(f"the two sides differ along {on!r}")
        how = "inner"
    return left.join(right, on, {"outer": "full"}.get(how, how))


def group_median_anomaly(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Value minus its group median; groups may be of any size."""
    med = quantile_table(df, value, [0.5], by).select(*by, F.col("q0").alias("_m"))
    return df.join(med, list(by), "left").withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def coverage_sets(rows: DataFrame, key: str, ok: Column, supported: Column) -> DataFrame:
    """Each key once, as complete, unsupported or incomplete (in that order of precedence)."""
    per = rows.groupBy(key).agg(
        F.bool_and(ok & supported).alias("_all"), F.bool_and(~supported).alias("_none"), F.bool_or(~supported).alias("_some")
    )
    status = F.when(F.col("_all"), "complete").when(F.col("_some"), "unsupported").otherwise("incomplete")
    return per.select(key, status.alias("coverage"))


# --- pairs of places ---------------------------------------------------------


def places_of(cube: DataFrame) -> DataFrame:
    """Distinct cells with their flat index and label."""
    width = cube.agg(F.max("x_idx") + 1).scalar()
    cells = cube.select(*CELL, "y", "x").distinct()
    return cells.select(
        (F.col("y_idx") * width + F.col("x_idx")).alias("space"), "y_idx", "x_idx", "y", "x", C.place_label("y", "x").alias("label")
    )


def _ends(places: DataFrame, side: str) -> DataFrame:
    return places.select(
        F.col("space").alias(side), F.col("y").alias(f"_{side}_y"), F.col("x").alias(f"_{side}_x")
    )


def _distance() -> Column:
    return C.place_distance(F.col("_source_y"), F.col("_source_x"), F.col("_target_y"), F.col("_target_x"))


def _within_radius(places: DataFrame, radius: float) -> DataFrame:
    """All pairs source < target with distance <= radius, by tiles.

    Pairs of degree coordinates are bucketed in latitude bands whose longitude
    step widens towards the poles and closes at the dateline; pairs with a
    coordinate outside the degree range use plain square tiles.
    """
    s, t = _ends(places, "source"), _ends(places, "target")
    step = max(radius / KM_PER_DEGREE, 1e-9) * 1.000001
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    geographic = lambda p: (F.abs(F.col(f"_{p}_x")) <= 180) & (F.abs(F.col(f"_{p}_y")) <= 90)

    def columns_in(band: Column) -> Column:
        """Number of equal longitude buckets a band is cut into."""
        edge = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * step, F.lit(89.999))
        return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / F.lit(step * 1.6)), F.lit(1)).cast("bigint")

    def column(lon: Column, n: Column) -> Column:
        return F.least(F.floor((lon + 180) / 360.0 * n), n - 1).cast("bigint")

    band = lambda p: F.floor(F.col(f"_{p}_y") / step).cast("bigint")
    gs = s.where(geographic("source")).withColumn("_b", F.explode(F.transform(offsets, lambda o: band("source") + o)))
    gs = gs.withColumn("_n", columns_in(F.col("_b")))
    gs = gs.withColumn(
        "_c",
        F.explode(F.array_distinct(F.transform(offsets, lambda o: F.pmod(column(F.col("_source_x"), F.col("_n")) + o, F.col("_n"))))),
    ).drop("_n")
    gt = t.where(geographic("target")).withColumn("_b", band("target"))
    gt = gt.withColumn("_c", column(F.col("_target_x"), columns_in(F.col("_b"))))
    ordered = F.col("source") < F.col("target")
    near = gs.join(gt, ["_b", "_c"]).where(ordered)

    flat = lambda c: F.floor(F.col(c) / max(radius, 1e-9)).cast("bigint")
    ps = s.withColumn("_b", F.explode(F.transform(offsets, lambda o: flat("_source_y") + o)))
    ps = ps.withColumn("_c", F.explode(F.transform(offsets, lambda o: flat("_source_x") + o)))
    pt = t.withColumns({"_b": flat("_target_y"), "_c": flat("_target_x")})
    # two degree places never meet here, however few tiles the degree range has at this radius
    plane = ps.where(~geographic("source")).join(pt, ["_b", "_c"]).where(ordered)
    mixed = ps.where(geographic("source")).join(pt.where(~geographic("target")), ["_b", "_c"]).where(ordered)
    out = near.unionByName(plane).unionByName(mixed).withColumn("distance", _distance())
    return out.where(F.col("distance") <= radius).select("source", "target", "distance")


def _near_candidates(places: DataFrame, radius: float, k: int) -> DataFrame:
    """source, target, distance within ``radius``, both directions: the ``k`` nearest of every place among them.

    Places outside the degree range bring their k nearest by a neighbour search, not everything within the radius, as sources
    and as targets. Two degree places meet on tiles: their distance is no straight line.
    """
    places = cut_lineage(places.select("space", "y", "x"), "places")
    degrees = F.coalesce((F.abs("x") <= 180) & (F.abs("y") <= 90), F.lit(False))
    globe, plane, every = places.where(degrees), places.where(~degrees), places
    near = _within_radius(globe, radius)
    both = near.unionByName(near.select(F.col("target").alias("source"), F.col("source").alias("target"), "distance"))
    points = lambda p: p.select(F.col("space").alias("id"), "y", "x")
    if plane.isEmpty():
        return both
    found = knn_join(points(every), points(plane), k, ["y", "x"]).unionByName(knn_join(points(plane), points(globe), k, ["y", "x"]))
    pairs = found.select(F.col("query_id").alias("source"), F.col("neighbor_id").alias("target"))
    measured = pairs.join(_ends(places, "source"), "source").join(_ends(places, "target"), "target").withColumn("distance", _distance())
    return both.unionByName(measured.where(F.col("distance") <= radius).select("source", "target", "distance"))


def _nearest_k(places: DataFrame, k: int) -> DataFrame:
    """k nearest of every place, both directions merged to source < target.

    Degree coordinates are compared as points on the unit sphere, where the
    straight-line order equals the great-circle order.
    """
    lat, lon = F.radians("y"), F.radians("x")
    degrees = (F.max(F.abs(F.col("x"))) <= 180) & (F.max(F.abs(F.col("y"))) <= 90)
    if places.agg(degrees).first()[0]:  # bounded probe: one row
        pts = places.select(
            F.col("space").alias("id"), (F.cos(lat) * F.cos(lon)).alias("a"), (F.cos(lat) * F.sin(lon)).alias("b"), F.sin(lat).alias("c")
        )
        found = knn_join(pts, pts, k, ["a", "b", "c"])
    else:
        if places.where((F.abs(F.col("x")) <= 180) & (F.abs(F.col("y")) <= 90)).limit(1).count():
            raise ValueError("coordinates mix degrees and plane units; give a radius or one kind of coordinate")
        found = knn_join(places.select(F.col("space").alias("id"), "y", "x"), places.select(F.col("space").alias("id"), "y", "x"), k, ["y", "x"])
    pairs = found.select(F.least("query_id", "neighbor_id").alias("source"), F.greatest("query_id", "neighbor_id").alias("target")).distinct()
    out = pairs.join(_ends(places, "source"), "source").join(_ends(places, "target"), "target")
    return out.select("source", "target", _distance().alias("distance"))


def _block(c: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _every_pair(places: DataFrame, blocks: int = 16) -> DataFrame:
    """All pairs source < target. Quadratic by definition of the mode: each place
    visits ``blocks`` block pairs and meets the others there in an equi-join."""
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    s = _ends(places, "source").withColumn("_b", _block("source", blocks)).withColumn("_o", F.explode(ids))
    t = _ends(places, "target").withColumn("_o", _block("target", blocks)).withColumn("_b", F.explode(ids))
    return s.join(t, ["_b", "_o"]).where(F.col("source") < F.col("target")).select("source", "target", _distance().alias("distance"))


def spatial_pairs(places: DataFrame, mode: str = "neighbors", *, radius: float | None = None, k: int | None = None, reference: int | None = None) -> DataFrame:
    """Pairs of places: source, target, distance.

    reference: every place with the reference (the centre cell by default),
    itself included; neighbors: within ``radius`` and / or the ``k`` nearest;
    all_pairs and regional: every pair; blocks: every pair of the labels in ``block``, without distances.
    """
    if mode == "blocks":
        if "block" not in places.columns:
            raise ValueError("blocks mode needs a block column")
        labels = places.select("block").distinct()
        both = labels.select(F.col("block").alias("source")).join(labels.select(F.col("block").alias("target")), F.col("source") < F.col("target"))
        return both.withColumn("distance", F.lit(None).cast("double"))
    if mode == "reference":
        if reference is None:
            mid = places.agg(
                F.struct(F.floor((F.max("y_idx") + 1) / 2).alias("cy"), F.floor((F.max("x_idx") + 1) / 2).alias("cx")).alias("m")
            ).scalar()
            ref = places.withColumn("_m", mid).where((F.col("y_idx") == F.col("_m.cy")) & (F.col("x_idx") == F.col("_m.cx")))
        else:
            ref = places.where(F.col("space") == reference)
        both = _ends(places, "source").join(F.broadcast(_ends(ref, "target")))  # one row
        return both.select("source", "target", _distance().alias("distance"))
    if mode in {"all_pairs", "regional"}:
        return _every_pair(places)
    if mode != "neighbors":
        raise ValueError("mode must be reference, neighbors, all_pairs, regional or blocks")
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    if radius is None:
        return _every_pair(places) if k is None else _nearest_k(places, k)
    if k is None:
        return _within_radius(places, radius)
    order = W.partitionBy("source").orderBy(F.round("distance", 9), "target")
    kept = _near_candidates(places, radius, k).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return kept.select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "distance"
    ).dropDuplicates(["source", "target"])
