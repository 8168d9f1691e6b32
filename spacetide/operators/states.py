"""State cubes: state, magnitude (signed distance past the threshold) and threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CELL
from .verbs import lag_periods, rolling_quantile, shifted

# Thresholds meet floating-point results, so both sides are rounded before the test.
DIGITS = 9


def _state(df: DataFrame, signal: Column, threshold: Column, direction: str) -> DataFrame:
    if direction not in {"above", "below"}:
        raise ValueError("direction must be 'above' or 'below'")
    v, t = F.round(signal, DIGITS), F.round(threshold, DIGITS)
    state = v >= t if direction == "above" else v <= t
    magnitude = v - t if direction == "above" else t - v
    return df.withColumns({"state": C.is_true(state), "magnitude": magnitude, "threshold": t})


def threshold_state(cube: DataFrame, threshold: float | DataFrame, direction: str = "above") -> DataFrame:
    """Scalar threshold, or a field (y_idx, x_idx, threshold). A missing value is inactive."""
    if isinstance(threshold, DataFrame):
        field = threshold.select(*CELL, F.col("threshold").alias("_t"))
        return _state(cube.join(field, list(CELL), "left"), F.col("value"), F.col("_t"), direction).drop("_t")
    return _state(cube, F.col("value"), F.lit(float(threshold)), direction)


exceedance = threshold_state


def quantile_state(cube: DataFrame, q: float, direction: str = "above", *, rolling_window: int | None = None, climatology: DataFrame | None = None) -> DataFrame:
    """Threshold from the cell's own quantile, a rolling quantile, or a supplied climatology (wins)."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be between 0 and 1")
    if climatology is not None:
        return threshold_state(cube, climatology, direction)
    if rolling_window is not None:
        rolled = rolling_quantile(cube, rolling_window, q, "_t")
    else:  # one cell's days: bounded by the calendar
        rolled = cube.withColumn("_t", F.percentile("value", F.lit(q)).over(W.partitionBy(*CELL)))
    return _state(rolled, F.col("value"), F.col("_t"), direction).drop("_t")


def binary_state(cube: DataFrame, value: str | Column = "value") -> DataFrame:
    """Mask to state; magnitude is 1 or 0 and the threshold 0. NULL counts as inactive."""
    v = C.as_col(value)
    active = C.is_true(v.cast("double") != 0)
    return cube.withColumns(
        {"state": active, "magnitude": F.when(active, 1.0).otherwise(0.0), "threshold": F.lit(0.0)}
    )


def change_state(indexed: DataFrame, change: str, threshold: float, lag: int | str) -> DataFrame:
    """Lagged absolute or relative change at or above a threshold."""
    if change not in {"absolute", "relative"}:
        raise ValueError("change must be 'absolute' or 'relative'")
    periods = lag_periods(indexed, lag, floor=1)
    before = shifted("value", periods)
    stepped = indexed.withColumn("_b", before)
    delta = F.col("value") - F.col("_b")
    signal = delta if change == "absolute" else C.ratio(delta, F.col("_b"))
    return _state(stepped, signal, F.lit(float(threshold)), "above").drop("_b")
