"""The long cube: one row per (time, y_idx, x_idx[, variable]) with a nullable value.

``time`` is a DATE, ``y`` / ``x`` are coordinates and ``y_idx`` / ``x_idx`` their
positions on the grid. A missing value is NULL, never NaN. Windows count grid
positions through ``t_idx``, so they are right on sparse cubes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.columns import as_col, finite

CELL = ("y_idx", "x_idx")
STD_EPS = 1e-4


def null_missing(df: DataFrame, *cols: str) -> DataFrame:
    """NaN and infinite values to NULL, once, at ingest."""
    return df.withColumns({c: finite(c) for c in cols})


def long_cube(df: DataFrame, *, time, y, x, value, reducer=F.avg, variable=None, digits: int = 9) -> DataFrame:
    """Rows to a cube: one value per cell and day, reduced before the shuffle.

    Whatever the skew of the input, a cell keeps at most one row per day, which
    is what bounds every later per-cell window.
    """
    keys = [as_col(time).cast("date").alias("time"), as_col(y).alias("y_idx"), as_col(x).alias("x_idx")]
    if variable is not None:
        keys.append(as_col(variable).alias("variable"))
    return (
        df.select(*keys, finite(value).alias("_v"))
        .groupBy(*[c for c in ("time", "y_idx", "x_idx", "variable") if variable is not None or c != "variable"])
        .agg(F.round(reducer("_v"), digits).alias("value"))
        .withColumn("y", F.col("y_idx").cast("double"))
        .withColumn("x", F.col("x_idx").cast("double"))
    )


def axis(df: DataFrame, column: str, index: str) -> DataFrame:
    """Distinct coordinates of one axis with their zero-based position.

    The axis (days, rows or columns of the grid) is small by nature; it is
    gathered as one sorted array, never the data.
    """
    packed = df.select(column).distinct().agg(F.array_sort(F.collect_set(column)).alias("_a"))
    return packed.select(F.posexplode("_a").alias(index, column))


def grid_axes(cube: DataFrame) -> DataFrame:
    """Number of time steps, rows and columns (one row)."""
    return cube.agg(
        F.countDistinct("time").alias("nt"),
        (F.max("y_idx") + 1).alias("ny"),
        (F.max("x_idx") + 1).alias("nx"),
    )


def with_time_index(cube: DataFrame) -> DataFrame:
    """Add ``t_idx``, the position of ``time`` on the cube's time axis."""
    return cube.join(axis(cube, "time", "t_idx"), "time")


def index_cube(cube: DataFrame, *, dense: bool = True) -> DataFrame:
    """Add ``t_idx``; with ``dense`` also add a NULL row for every missing (cell, time).

    Cells carry the time axis as an exploded array, so densifying is a map over
    the distinct cells followed by one equi-join, not a row-by-row product.
    """
    if not dense:
        return with_time_index(cube)
    steps = cube.select("time").distinct().agg(F.array_sort(F.collect_set("time")).alias("_a"))
    cells = cube.select("y_idx", "x_idx", "y", "x").distinct()
    # .scalar() is an uncorrelated subquery: one array of dates, bounded by the calendar
    grid = cells.select("*", F.posexplode(steps.scalar()).alias("t_idx", "time"))
    return grid.join(cube.select("time", *CELL, "value"), ["time", *CELL], "left")


def cell_window_key() -> list[Column]:
    return [F.col(c) for c in CELL]
