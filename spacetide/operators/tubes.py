"""Space-time connected components of a mask, their metrics and cross-sections."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CELL
from ..session import cut_lineage, drop_path, scratch_path

def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) by alternating star contractions.

    Each round is two group-minimum steps and is written to the shared folder;
    the number of rounds grows with the logarithm of the component size. Edges
    of a hub are spread over tasks: the minimum is combined before the shuffle
    and the join back on the hub is split by AQE. All joins sort and merge: a stage's
    files are many times smaller than its rows, so their size must not choose a broadcast.
    """
    links = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct()
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "links")
        df.write.parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        return kept, path, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links, path, mark = stored(links)
    while True:  # ends: every round lowers a label or changes nothing
        # large star: hang every larger neighbour on the smallest member
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(low.hint("merge"), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: hang the smaller neighbours and the node itself on the smallest one
        top = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(top.hint("merge"), "b")
        nxt = (
            small.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(small.select(F.col("m").alias("a"), "b"))
            .where("a < b")
            .distinct()
        )
        links, new_path, new_mark = stored(nxt)
        drop_path(spark, path)
        path, same, mark = new_path, new_mark == mark, new_mark
        if same:
            break
    labels = links.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "node")
    return nodes.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def label_tubes(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """6- or 26-connected components of the true voxels (t_idx, y_idx, x_idx, mask).

    Consecutive steps of one cell form one node, which removes the time axis
    from the iteration; voxel neighbours meet in an equi-join on the shifted
    voxel. tube_id is 1.. in the order of each tube's first voxel (t, y, x).
    """
    if connectivity not in {6, 26}:
        raise ValueError("connectivity must be 6 or 26")
    extra = [c for c in ("time", "y", "x") if c in mask.columns]
    true = mask.where("mask").select("t_idx", *CELL, *extra)
    run_start = F.col("t_idx") - F.row_number().over(W.partitionBy(*CELL).orderBy("t_idx"))
    size = mask.agg(F.struct((F.max("y_idx") + 1).alias("ny"), (F.max("x_idx") + 1).alias("nx")).alias("s")).scalar()
    first = F.min("t_idx").over(W.partitionBy(*CELL, "_g"))
    voxels = true.withColumn("_g", run_start).withColumn("_f", first).withColumn("_s", size)
    # a node is the linear index of its first voxel
    node = (F.col("_f") * F.col("_s.ny") + F.col("y_idx")) * F.col("_s.nx") + F.col("x_idx")
    voxels = cut_lineage(voxels.withColumn("node", node.cast("bigint")).drop("_g", "_f", "_s"), "voxels")
    if connectivity == 6:
        steps = [(0, 1, 0), (0, 0, 1)]
    else:
        steps = [s for s in product((-1, 0, 1), repeat=3) if (s[1], s[2], s[0]) > (0, 0, 0)]
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("dt", "dy", "dx"))]) for s in steps]))
    moved = voxels.select(F.col("node").alias("u"), "t_idx", *CELL, shift.alias("o")).select(
        "u", (F.col("t_idx") + F.col("o.dt")).alias("t_idx"), (F.col("y_idx") + F.col("o.dy")).alias("y_idx"), (F.col("x_idx") + F.col("o.dx")).alias("x_idx")
    )
    edges = moved.join(voxels.select("t_idx", *CELL, F.col("node").alias("v")).hint("merge"), ["t_idx", *CELL]).select("u", "v").where("u <> v").distinct()
    nodes = voxels.select("node").distinct()
    labels = _components(edges, nodes)
    return number_tubes(voxels.join(labels.hint("merge"), "node").drop("node"))


def number_tubes(labelled: DataFrame) -> DataFrame:
    """Labels to 1.. in label order (two-level numbering, no global window)."""
    ids = labelled.select("label").distinct()
    slots = ids.withColumn("_slot", F.floor(F.sqrt(F.col("label").cast("double"))).cast("bigint"))
    per = slots.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    coarse = per.withColumn("_c", F.floor(F.sqrt(F.col("_slot").cast("double"))).cast("bigint"))
    block = coarse.groupBy("_c").agg(F.sum("_n").alias("_n"))
    # a fourth root of the grid's voxel count: a few thousand entries at most
    packed = block.agg(F.array_sort(F.collect_list(F.struct("_c", "_n"))).alias("_a"))
    base = packed.select("_a", F.posexplode("_a").alias("_i", "_e")).select(
        F.col("_e._c").alias("_c"),
        F.aggregate(F.slice("_a", F.lit(1), F.col("_i")), F.lit(0).cast("bigint"), lambda s, e: s + e["_n"]).alias("_b"),
    )
    offset = coarse.withColumn("_o", F.sum("_n").over(W.partitionBy("_c").orderBy("_slot")) - F.col("_n")).join(base, "_c")
    numbered = slots.withColumn("_k", F.row_number().over(W.partitionBy("_slot").orderBy("label"))).join(
        offset.select("_slot", (F.col("_o") + F.col("_b")).alias("_o")).hint("merge"), "_slot"
    )
    return labelled.join(numbered.select("label", (F.col("_o") + F.col("_k")).alias("tube_id")).hint("merge"), "label").drop("label")


def tube_metrics(tubes: DataFrame) -> DataFrame:
    """Duration, voxels, extents and cells per step; reduced per (tube, step) first."""
    steps = tubes.groupBy("tube_id", "time").agg(
        F.count(F.lit(1)).alias("_n"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1")
    )
    return steps.groupBy("tube_id").agg(
        F.count(F.lit(1)).alias("duration_steps"), F.sum("_n").alias("n_voxels"),
        F.min("time").alias("time_start"), F.max("time").alias("time_end"),
        F.min("_y0").alias("y_min"), F.max("_y1").alias("y_max"), F.min("_x0").alias("x_min"), F.max("_x1").alias("x_max"),
        F.avg("_n").alias("cells_per_timestep_mean"), F.max("_n").alias("cells_per_timestep_max"),
    )


def select_tube(metrics: DataFrame, which: str | int = "longest") -> DataFrame:
    """The longest or largest tube (one row), or a tube by id."""
    if which == "longest":
        order = [F.desc("duration_steps"), F.desc("n_voxels"), "tube_id"]
    elif which == "largest":
        order = [F.desc("n_voxels"), F.desc("duration_steps"), "tube_id"]
    else:
        return metrics.where(F.col("tube_id") == which)
    return metrics.orderBy(*order).limit(1)


def masked_points(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of the cube where the mask is true and the value present."""
    true = mask.where("mask").select("time", *CELL)
    return cube.where(F.col("value").isNotNull()).join(true, ["time", *CELL], "left_semi").select("time", "y", "x", "value")


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) >= 2:
                a, b = out[-1] - out[-2], p - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def tube_sections(tubes: DataFrame) -> DataFrame:
    """Convex hull of every (tube, time) slice as an open ring; slices without area are skipped.

    Only the two end cells of each grid row of a slice can lie on its hull, so a
    slice is reduced to its row ends before it reaches a Python task.
    """
    ends = tubes.groupBy("tube_id", "time", "y").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    pts = ends.select("tube_id", "time", "y", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("x"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _hull(pdf[["x", "y"]].to_numpy(float))
        if len(ring) < 3:
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"tube_id": none.astype("int64"), "time": none, "ring": none})
        return pd.DataFrame(
            {"tube_id": [key[0]], "time": [key[1]], "ring": [[{"x": float(a), "y": float(b)} for a, b in ring]]}
        )

    return pts.groupBy("tube_id", "time").applyInPandas(one, "tube_id long, time date, ring array<struct<x: double, y: double>>")
