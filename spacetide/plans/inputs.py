"""How the driver tables stand in for cubes, trajectories and perimeters.

Each Spark input has a SQL twin (a CTE text) so that both sides of a comparison
start from the same rows. Doubles are rounded where they enter, which keeps
later threshold tests identical in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import all_present, region_of
from ..model import long_cube


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- cubes -------------------------------------------------------------------

CUBE = """cube AS (
  SELECT CAST(ts AS DATE) AS time, CAST(user_id // 10 AS BIGINT) AS y_idx, CAST(user_id % 10 AS BIGINT) AS x_idx,
         round(avg(value), 9) AS value
  FROM events GROUP BY ALL)"""

MULTI = """multi AS (
  SELECT CAST(ts AS DATE) AS time, CAST(user_id // 10 AS BIGINT) AS y_idx, CAST(user_id % 10 AS BIGINT) AS x_idx,
         event_type AS variable, round(avg(value), 9) AS value
  FROM events GROUP BY ALL)"""

SHIP = """ship AS (
  SELECT CAST(l_shipdate AS DATE) AS time, CAST(l_suppkey // 10 AS BIGINT) AS y_idx, CAST(l_suppkey % 10 AS BIGINT) AS x_idx,
         round(avg(l_quantity), 9) AS value
  FROM lineitem GROUP BY ALL)"""

AXIS = "axis AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM cube))"
CELLS = "cells AS (SELECT DISTINCT y_idx, x_idx FROM cube)"
GRID = """grid AS (
  SELECT a.time, a.t_idx, c.y_idx, c.x_idx, k.value
  FROM axis a CROSS JOIN cells c LEFT JOIN cube k ON k.time = a.time AND k.y_idx = c.y_idx AND k.x_idx = c.x_idx)"""
DENSE = f"{CUBE},\n{AXIS},\n{CELLS},\n{GRID}"


def events_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return long_cube(e, time="ts", y=F.floor(F.col("user_id") / 10), x=F.col("user_id") % 10, value="value")


def multi_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return long_cube(
        e, time="ts", y=F.floor(F.col("user_id") / 10), x=F.col("user_id") % 10, value="value", variable="event_type"
    )


def ship_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return long_cube(
        li, time="l_shipdate", y=F.floor(F.col("l_suppkey") / 10), x=F.col("l_suppkey") % 10, value="l_quantity"
    )


# --- event trajectories ------------------------------------------------------

PLACES = """places AS (
  SELECT CAST(c_custkey AS VARCHAR) AS fire_id, c_custkey, c_nationkey, c_mktsegment,
         round(CAST(-125 + 2.4 * c_nationkey AS DOUBLE), 6) AS lon, CAST(24 + c_custkey % 27 AS DOUBLE) AS lat
  FROM customer)"""

DAILY = """daily AS (
  SELECT CAST(o_custkey AS VARCHAR) AS fire_id, CAST(o_orderdate AS DATE) AS timestamp,
         round(sum(o_totalprice) / 10000, 6) AS ring_area_km2, CAST(count(*) AS BIGINT) AS pixels
  FROM orders GROUP BY ALL)"""

RINGS = f"""{DAILY},
rings AS (
  SELECT fire_id, timestamp, CAST(year(timestamp) AS INTEGER) AS year, ring_area_km2, pixels,
         CAST(row_number() OVER w - 1 AS INTEGER) AS slice_index,
         round(sum(ring_area_km2) OVER w, 6) AS cumulative_area_km2,
         CAST(count(*) OVER (PARTITION BY fire_id) AS INTEGER) AS n_obs
  FROM daily WINDOW w AS (PARTITION BY fire_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
shaped AS (
  SELECT *, round(sqrt(cumulative_area_km2 / max(cumulative_area_km2) OVER (PARTITION BY fire_id)), 9) AS normalized_vase_width
  FROM rings)"""

# every fifth cell has no climate, so that gaps occur
WEEKLY = """weekly AS (
  SELECT week, cell, CASE WHEN cell % 5 <> 3 THEN t END AS maximum_temperature_c, CASE WHEN cell % 5 <> 3 THEN lo END AS minimum_temperature_c,
         CASE WHEN cell % 5 <> 3 THEN v END AS vpd_kpa, CASE WHEN cell % 5 <> 3 THEN w END AS wind_speed_m_s
  FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(l_suppkey % 25 AS INTEGER) AS cell,
               round(avg(l_quantity), 6) AS t, round(min(l_quantity), 6) AS lo, round(avg(l_discount) * 30, 6) AS v, round(avg(l_tax) * 100, 6) AS w
        FROM lineitem GROUP BY ALL))"""

SLICES = f"""{PLACES},
{RINGS},
{WEEKLY},
slices AS (
  SELECT s.*, p.lon, p.lat, w.maximum_temperature_c, w.minimum_temperature_c, w.vpd_kpa, w.wind_speed_m_s,
         coalesce(w.wind_speed_m_s > 0.1, false) AS wind_present,
         (w.maximum_temperature_c IS NOT NULL) AS climate_available
  FROM shaped s JOIN places p ON p.fire_id = s.fire_id
  LEFT JOIN weekly w ON w.week = CAST(date_trunc('week', s.timestamp) AS DATE) AND w.cell = p.c_nationkey)"""

REGION_CASE = """CASE WHEN lat >= 50 AND lon BETWEEN -170 AND -130 THEN 'alaska'
  WHEN lat BETWEEN 18 AND 23 AND lon BETWEEN -161 AND -154 THEN 'hawaii'
  WHEN NOT (lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50) THEN 'outside_conus'
  WHEN lon < -112 THEN 'west' WHEN lon < -96 THEN 'intermountain' WHEN lon < -84 THEN 'central' ELSE 'east' END"""

TRAITS_ONLY = f"""traits AS (
  SELECT d.fire_id, CAST(year(min(d.timestamp)) AS INTEGER) AS year, {REGION_CASE} AS region,
         round(sum(d.ring_area_km2), 6) AS total_area_km2,
         CAST((date_diff('day', min(d.timestamp), max(d.timestamp)) + 1) * 24 AS DOUBLE) AS duration_hours,
         p.lon, p.lat
  FROM daily d JOIN places p ON p.fire_id = d.fire_id GROUP BY d.fire_id, p.lon, p.lat)"""

TRAITS = f"{PLACES},\n{DAILY},\n{TRAITS_ONLY}"
FIRES = f"{SLICES},\n{TRAITS_ONLY}"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("fire_id"),
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        F.round(F.lit(-125.0) + F.lit(2.4) * F.col("c_nationkey"), 6).alias("lon"),
        (F.lit(24) + F.col("c_custkey") % 27).cast("double").alias("lat"),
    )


def daily_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event and day; the day bounds the length of any event's series."""
    o = table(spark, sf_dir, "orders")
    return (
        o.select(
            F.col("o_custkey").cast("string").alias("fire_id"),
            F.col("o_orderdate").cast("date").alias("timestamp"),
            "o_totalprice",
        )
        .groupBy("fire_id", "timestamp")
        .agg(
            F.round(F.sum("o_totalprice") / 10000, 6).alias("ring_area_km2"),
            F.count(F.lit(1)).alias("pixels"),
        )
    )


def shaped_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = W.partitionBy("fire_id").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("fire_id")
    return (
        daily_growth(spark, sf_dir)
        .withColumn("year", F.year("timestamp"))
        .withColumn("slice_index", F.row_number().over(W.partitionBy("fire_id").orderBy("timestamp")) - 1)
        .withColumn("cumulative_area_km2", F.round(F.sum("ring_area_km2").over(run), 6))
        .withColumn("n_obs", F.count(F.lit(1)).over(whole).cast("int"))
        .withColumn(
            "normalized_vase_width",
            F.round(F.sqrt(F.col("cumulative_area_km2") / F.max("cumulative_area_km2").over(whole)), 9),
        )
    )


def weekly_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    known = lambda value: F.when(F.col("cell") % 5 != 3, F.round(value, 6))
    sums = li.groupBy(
        F.date_trunc("week", "l_shipdate").cast("date").alias("week"),
        (F.col("l_suppkey") % 25).cast("int").alias("cell"),
    ).agg(F.avg("l_quantity").alias("t"), F.min("l_quantity").alias("lo"), (F.avg("l_discount") * 30).alias("v"), (F.avg("l_tax") * 100).alias("w"))
    return sums.select(
        "week",
        "cell",
        known(F.col("t")).alias("maximum_temperature_c"),
        known(F.col("lo")).alias("minimum_temperature_c"),
        known(F.col("v")).alias("vpd_kpa"),
        known(F.col("w")).alias("wind_speed_m_s"),
    )


CLIMATE = ["maximum_temperature_c", "minimum_temperature_c", "vpd_kpa", "wind_speed_m_s"]


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shaped_slices(spark, sf_dir).join(
        places(spark, sf_dir).select("fire_id", "lon", "lat", F.col("c_nationkey").alias("cell")), "fire_id"
    )
    s = s.withColumn("week", F.date_trunc("week", "timestamp").cast("date"))
    return (
        s.join(weekly_climate(spark, sf_dir), ["week", "cell"], "left")
        .withColumn("wind_present", F.coalesce(F.col("wind_speed_m_s") > 0.1, F.lit(False)))
        .withColumn("climate_available", all_present(CLIMATE))
        .drop("week", "cell")
    )


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_growth(spark, sf_dir)
    per = d.groupBy("fire_id").agg(
        F.year(F.min("timestamp")).alias("year"),
        F.round(F.sum("ring_area_km2"), 6).alias("total_area_km2"),
        ((F.datediff(F.max("timestamp"), F.min("timestamp")) + 1) * 24).cast("double").alias("duration_hours"),
    )
    p = places(spark, sf_dir)
    return per.join(p.select("fire_id", "lon", "lat"), "fire_id").withColumn("region", region_of("lon", "lat"))
