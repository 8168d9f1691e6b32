"""Batch work on rings against the folds of ``geometry``, and what it spares."""

import datetime as dt
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import rows
from spacetide.operators import geometry as G
from spacetide.operators import hull as H
from spacetide.operators import rings as R

D0 = dt.date(2020, 1, 1)


def _ring(rng, n):
    turns = sorted(rng.random() for _ in range(n))
    return [{"x": round(6 + 5 * rng.random() * math.cos(6.28 * t), 2), "y": round(6 + 5 * rng.random() * math.sin(6.28 * t), 2)} for t in turns]


def _rings(n):
    rng = random.Random(3)
    square = [{"x": float(x), "y": float(y)} for x, y in ((2, 2), (8, 2), (8, 8), (2, 8))]
    step = [{"x": float(x), "y": float(y)} for x, y in ((1, 1), (9, 1), (9, 5), (5, 5), (5, 9), (1, 9))]
    far = [{"x": p["x"] + 90, "y": p["y"]} for p in square]
    small = [{"x": 3.2 + x, "y": 3.2 + y} for x, y in ((0, 0), (0.1, 0), (0.1, 0.1))]
    return [square, step, far, small, [], None, *[_ring(rng, rng.randint(3, 9)) for _ in range(n)]]


def test_samples_equal_the_folds_and_join_nothing(spark):
    rings = [r for r in _rings(30) if r]
    p = spark.createDataFrame([(str(i), D0, r) for i, r in enumerate(rings)], f"fire_id string, date date, ring {G.RING}")
    cells = [(str(i), D0 + dt.timedelta(k), float(x), float(y), float(x * y)) for i in range(len(rings)) for k in (-1, 0, 2) for x in range(12) for y in range(12)]
    cube = spark.createDataFrame(cells, "fire_id string, time date, x double, y double, value double")
    got = H.sample_inside_outside(cube, p, dx=1.0, dy=1.0)
    x, y = F.col("x"), F.col("y")
    tested = cube.where(F.col("time") >= F.lit(D0)).join(p.drop("date"), "fire_id").withColumns(
        {"f": G.covers_box(F.col("ring"), x - 0.5, y - 0.5, x + 0.5, y + 0.5), "c": G.covers(F.col("ring"), x, y)})
    some = tested.groupBy("fire_id", "time").agg(F.bool_or("f").alias("any"))
    want = tested.join(some, ["fire_id", "time"]).withColumn("inside", F.when(F.col("any"), F.col("f")).otherwise(F.col("c")))
    cols = ("fire_id", "time", "x", "y", "value", "inside")
    assert rows(got, *cols) == rows(want, *cols)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_grid_spans_equal_the_folds(spark):
    rings = _rings(60)
    z = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"k int, ring {G.RING}")
    found = H.zonal_cells(z, ["k"], x0=0.0, dx=0.5, nx=24, y0=0.0, dy=0.5, ny=24)
    grid = spark.range(24).select(F.col("id").cast("int").alias("ix")).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("iy")))
    want = z.where(F.size("ring") > 0).crossJoin(grid).where(G.contains(F.col("ring"), F.col("ix") * 0.5, F.col("iy") * 0.5))
    assert rows(found.where("sample_method = 'grid_cells_inside_zone'"), "k", "ix", "iy") == rows(want, "k", "ix", "iy")
    with_cells = {r[0] for r in rows(want, "k")}
    rest = {r["k"]: (r["ix"], r["iy"], r["sample_method"]) for r in found.where("sample_method <> 'grid_cells_inside_zone'").collect()}
    assert set(rest) == set(range(len(rings))) - with_cells
    assert all(rest[k] == (None, None, "outside_grid") for k in (2, 4, 5)) and rest[3][2] == "fallback_nearest_cell_to_zone"
    points = z.where(F.col("k").isin([k for k in rest if rest[k][0] is not None])).select("k", G.representative_point(F.col("ring")).alias("p")).collect()
    near = lambda v: min(max(math.ceil(round(v / 0.5, 9) - 0.5), 0), 23)
    assert points and all(rest[r["k"]][:2] == (near(r["p"]["x"]), near(r["p"]["y"])) for r in points)


def test_support_equals_the_folds(spark):
    rings = [r for r in _rings(40) if r]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"k int, ring {G.RING}")
    want = df.select("k", G.perimeter(F.col("ring")).alias("p"), F.abs(G.signed_area(F.col("ring"))).alias("a"), G.sample_ring(F.col("ring"), 10, closed=False).alias("s")).orderBy("k").collect()
    around, area, radii = R.support(pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), 10, 8)
    for i, w in enumerate(want):
        mx, my = (sum(q[c] for q in w["s"]) / 10 for c in ("x", "y"))
        best = [max((q["x"] - mx) * math.cos(math.pi * k / 4) + (q["y"] - my) * math.sin(math.pi * k / 4) for q in w["s"]) for k in range(8)]
        assert abs(around[i] - w["p"]) < 1e-9 and abs(area[i] - w["a"]) < 1e-9
        assert max(abs(a - b) for a, b in zip(best, radii[i])) < 1e-9
