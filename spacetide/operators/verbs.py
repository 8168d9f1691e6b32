"""Cube verbs: filters, reducers, anomalies, rolling statistics.

Per-cell windows are ordered by ``t_idx`` and framed by range, so they count
grid positions whether or not missing cells have rows. A cell has at most one
row per day, which bounds each window partition by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ranking import average_rank, quantile_table
from ..model import CELL, STD_EPS, axis

# --- composition -------------------------------------------------------------


class pipe:  # noqa: N801 - reads as a verb at the call site
    """``pipe(cube) | verb | verb``; each verb maps DataFrame to DataFrame."""

    def __init__(self, value: DataFrame):
        self.value = value

    def __or__(self, verb: Callable[[DataFrame], DataFrame]) -> pipe:
        if not callable(verb):
            raise TypeError("a pipe step must be callable")
        return pipe(self.value.transform(verb))

    def unwrap(self) -> DataFrame:
        return self.value


def apply(func: Callable[..., DataFrame], **kwargs):
    """User verb: any function of a DataFrame with its keyword arguments bound."""
    return lambda df: df.transform(func, **kwargs)


# --- filters and masks -------------------------------------------------------


def month_filter(df: DataFrame, months: Iterable[int], time: str = "time") -> DataFrame:
    if dict(df.dtypes)[time].split("(")[0] not in {"date", "timestamp", "timestamp_ntz"}:
        raise ValueError(f"{time!r} is not datetime-like")
    return df.where(F.month(time).isin(sorted(set(months))))


_COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def threshold_mask(value: str | Column, threshold, op: str = ">") -> Column:
    if op not in _COMPARE:
        raise ValueError("op must be one of >, >=, <, <=")
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return C.is_true(_COMPARE[op](C.as_col(value), t))


def select_cohort(df: DataFrame, **filters) -> DataFrame:
    """AND of predicates: a function of the column, a collection, or a value."""
    for name, expected in filters.items():
        column = F.col(name)
        if callable(expected) and not isinstance(expected, Column):
            df = df.where(C.is_true(expected(column)))
        elif isinstance(expected, (set, tuple, list, frozenset)):
            df = df.where(column.isin(*expected))
        else:
            df = df.where(column.eqNullSafe(F.lit(expected)))
    return df


def suitability(value: str | Column, lo: float = 0.3, hi: float = 0.8) -> Column:
    return C.is_true(C.as_col(value).between(lo, hi))


def normalized_difference(nir: Column, red: Column, eps: float = 0.0) -> Column:
    return C.ratio(nir - red, nir + red + F.lit(eps)).cast("float")


def ndvi(cube: DataFrame, nir: str, red: str, eps: float = 0.0) -> DataFrame:
    """Two bands of a multi-variable cube to one index per (time, cell)."""
    pair = cube.where(F.col("variable").isin(nir, red)).groupBy("time", *CELL).agg(
        F.max(F.when(F.col("variable") == nir, F.col("value"))).alias("_nir"),
        F.max(F.when(F.col("variable") == red, F.col("value"))).alias("_red"),
    )
    return pair.select("time", *CELL, normalized_difference(F.col("_nir"), F.col("_red"), eps).alias("value"))


def grid_width(cube: DataFrame) -> Column:
    """Number of columns of the grid, as an uncorrelated subquery."""
    return cube.agg(F.max("x_idx") + 1).scalar()


def stack_space(cube: DataFrame, nx: Column | int | None = None) -> DataFrame:
    """Add ``space = y_idx * nx + x_idx``."""
    width = grid_width(cube) if nx is None else (F.lit(nx) if isinstance(nx, int) else nx)
    return cube.withColumn("space", F.col("y_idx") * width + F.col("x_idx"))


def unstack_space(df: DataFrame, nx: int) -> DataFrame:
    return df.withColumns(
        {"y_idx": F.floor(F.col("space") / nx), "x_idx": F.pmod(F.col("space"), F.lit(nx))}
    )


def crop_to_finite(cube: DataFrame) -> DataFrame:
    """Keep the index bounding box of present values."""
    present = cube.where(F.col("value").isNotNull())
    box = present.agg(
        F.min("y_idx").alias("y0"), F.max("y_idx").alias("y1"), F.min("x_idx").alias("x0"), F.max("x_idx").alias("x1")
    )
    if box.first()["y0"] is None:  # bounded probe: one row
        raise ValueError("the cube has no finite cell")
    b = F.broadcast(box)  # exactly one row
    inside = F.col("y_idx").between(F.col("y0"), F.col("y1")) & F.col("x_idx").between(F.col("x0"), F.col("x1"))
    return cube.join(b, inside).drop("y0", "y1", "x0", "x1")


def stride(cube: DataFrame, n: int) -> DataFrame:
    """Every n-th time step."""
    if n < 1:
        raise ValueError("stride must be at least 1")
    steps = axis(cube, "time", "t_idx").where(F.col("t_idx") % n == 0)
    return cube.join(steps.select("time"), "time", "left_semi")


def select_variable(cube: DataFrame, name: str | None = None) -> DataFrame:
    """One variable; without a name the cube must hold exactly one."""
    if name is None:
        names = [r[0] for r in cube.select("variable").distinct().limit(2).collect()]
        if len(names) != 1:
            raise ValueError("variable= is required for a cube with several variables")
        name = names[0]
    return cube.where(F.col("variable") == name).drop("variable")


def temporal_support(daily: DataFrame, *, start, end, buffer_days: int, min_days: int, key: str, day: str, order: str) -> DataFrame:
    """First event (table order) with enough distinct days whose buffered span is covered."""
    spans = daily.groupBy(key).agg(
        F.countDistinct(day).alias("n_days"), F.min(day).alias("t0"), F.max(day).alias("t1"), F.min(order).alias("_first")
    )
    fits = (
        (F.col("n_days") >= min_days)
        & (F.date_sub("t0", buffer_days) >= F.lit(start).cast("date"))
        & (F.date_add("t1", buffer_days) <= F.lit(end).cast("date"))
    )
    return spans.where(fits).orderBy("_first", key).limit(1).drop("_first")


# --- reducers ----------------------------------------------------------------

DIMS = {"time": ["time"], "y": ["y_idx"], "x": ["x_idx"]}


def _kept(dims: str | Sequence[str]) -> list[str]:
    dims = [dims] if isinstance(dims, str) else list(dims)
    missing = [d for d in dims if d not in DIMS]
    if missing:
        raise ValueError(f"dimension(s) {missing} not in the cube")
    dropped = {c for d in dims for c in DIMS[d]}
    return [c for c in ("time", *CELL) if c not in dropped]


def reduce_cube(cube: DataFrame, dims: str | Sequence[str], *aggs: Column, keep_dim: bool = False) -> DataFrame:
    kept = _kept(dims)
    out = cube.groupBy(*kept).agg(*aggs) if kept else cube.agg(*aggs)
    if keep_dim:  # a length-1 axis is a constant index column
        for d in [dims] if isinstance(dims, str) else dims:
            out = out.withColumn(f"{d}_idx" if d == "time" else DIMS[d][0], F.lit(0))
    return out


def mean(cube: DataFrame, dims="time", keep_dim: bool = False, skipna: bool = True) -> DataFrame:
    value = F.avg("value")
    if not skipna:
        value = F.when(F.count("value") == F.count(F.lit(1)), value)
    return reduce_cube(cube, dims, value.alias("value"), keep_dim=keep_dim)


def variance(cube: DataFrame, dims="time", keep_dim: bool = False) -> DataFrame:
    return reduce_cube(cube, dims, F.var_pop("value").alias("value"), keep_dim=keep_dim)


def coarsen_mean(cube: DataFrame, fy: int, fx: int) -> DataFrame:
    """Block means; partial blocks at the far edges are trimmed."""
    if fy <= 0 or fx <= 0:
        raise ValueError("factors must be positive")
    size = cube.agg((F.max("y_idx") + 1).alias("_ny"), (F.max("x_idx") + 1).alias("_nx"))
    by, bx = F.floor(F.col("y_idx") / fy), F.floor(F.col("x_idx") / fx)
    whole = (by < F.floor(F.col("_ny") / fy)) & (bx < F.floor(F.col("_nx") / fx))
    return (
        cube.join(F.broadcast(size), whole)  # one row
        .groupBy("time", by.alias("y_idx"), bx.alias("x_idx"))
        .agg(F.avg("value").alias("value"))
    )


def auto_factor(size: int, largest: int) -> int:
    return max(1, -(-size // largest))


def unit_signature(df: DataFrame, unit: str | Column, reducer: str = "median") -> DataFrame:
    """Per unit and time (and variable): median or mean over space."""
    if reducer not in {"median", "mean"}:
        raise ValueError("reducer must be 'median' or 'mean'")
    keys = ["unit", "time"] + (["variable"] if "variable" in df.columns else [])
    tagged = df.withColumn("unit", C.as_col(unit))
    if reducer == "mean":
        return tagged.groupBy(*keys).agg(F.avg("value").alias("value"))
    return quantile_table(tagged, "value", [0.5], keys).withColumnRenamed("q0", "value")


def unit_coordinates(df: DataFrame, unit: str | Column) -> DataFrame:
    """Centre, minimum and maximum of each unit's distinct coordinates."""
    tagged = df.withColumn("unit", C.as_col(unit))
    out = None
    for d in ("y", "x"):
        part = (
            tagged.select("unit", d)
            .distinct()
            .groupBy("unit")
            .agg(F.avg(d).alias(f"{d}_center"), F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))
        )
        out = part if out is None else out.join(part, "unit")
    return out


def comparison_metrics(a: Column, b: Column) -> list[Column]:
    return [
        C.pearson(a, b).alias("pearson_r"),
        F.avg(a - b).alias("mean_difference"),
        F.sqrt(F.avg(F.pow(a - b, F.lit(2.0)))).alias("rmse"),
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n"),
    ]


def compare_signatures(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two signatures (time, variable, value): r, mean difference, RMSE, n per variable."""
    left = a.select("time", "variable", F.col("value").alias("_a"))
    right = b.select("time", "variable", F.col("value").alias("_b"))
    both = left.join(right, ["time", "variable"], how)
    return both.groupBy("variable").agg(*comparison_metrics(F.col("_a"), F.col("_b")))


def collect_units(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack signatures; a unit id may come from one input only."""
    parts = [first, *others]
    tagged = None
    for i, part in enumerate(parts):
        ids = part.select("unit").distinct().withColumn("_src", F.lit(i))
        tagged = ids if tagged is None else tagged.unionByName(ids)
    clash = tagged.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"unit ids must be unique, {clash[0]['unit']!r} occurs in several inputs")
    out = first
    for part in others:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def compare_units(signatures: DataFrame) -> DataFrame:
    """All i < j pairs of units. The number of units is chosen by the analyst (regions,
    blocks), so the pair list is part of the question, not of the data volume."""
    a = signatures.select("time", "variable", F.col("unit").alias("left_block"), F.col("value").alias("_a"))
    b = signatures.select("time", "variable", F.col("unit").alias("right_block"), F.col("value").alias("_b"))
    both = a.join(b, ["time", "variable"]).where(F.col("left_block") < F.col("right_block"))
    return (
        both.groupBy("left_block", "right_block", "variable")
        .agg(*comparison_metrics(F.col("_a"), F.col("_b")))
        .withColumn("pair", C.pair_label("left_block", "right_block"))
    )


# --- anomalies and rolling windows ------------------------------------------


def anomaly(cube: DataFrame, dim: str = "time") -> DataFrame:
    """Value minus its mean along ``dim``; the shape is kept."""
    kept = _kept(dim)
    centre = F.avg("value").over(W.partitionBy(*kept))
    if dim == "time":
        return cube.withColumn("value", F.col("value") - centre)
    means = cube.groupBy(*kept).agg(F.avg("value").alias("_m"))
    return cube.join(means, kept).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def zscore(cube: DataFrame, std_eps: float = STD_EPS, digits: int | None = None) -> DataFrame:
    w = W.partitionBy(*CELL)
    sd = F.stddev_pop("value").over(w)
    z = F.when(sd > std_eps, (F.col("value") - F.avg("value").over(w)) / sd)
    return cube.withColumn("value", z if digits is None else F.round(z, digits))


def baseline_anomaly(cube: DataFrame, start=None, end=None) -> DataFrame:
    """Value minus the cell's mean inside a closed time slice (whole record by default)."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("time") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("time") <= F.lit(end).cast("date"))
    base = F.avg(F.when(inside, F.col("value"))).over(W.partitionBy(*CELL))
    return cube.withColumn("value", F.col("value") - base)


def anomaly_against(cube: DataFrame, baseline: DataFrame) -> DataFrame:
    """Value minus the cell mean of another cube."""
    means = baseline.groupBy(*CELL).agg(F.avg("value").alias("_m"))
    return cube.join(means, list(CELL), "left").withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def _frame(lo: int, hi: int):
    return W.partitionBy(*CELL).orderBy("t_idx").rangeBetween(lo, hi)


def shifted(column: str, lag: int) -> Column:
    """The cell's value ``lag`` grid positions earlier (NULL when absent)."""
    return F.max(column).over(_frame(-lag, -lag))


def temporal_difference(indexed: DataFrame, lag: int = 1) -> DataFrame:
    return indexed.withColumn("value", F.col("value") - shifted("value", lag))


def rolling_mean(indexed: DataFrame, window: int, min_periods: int | None = None, center: bool = False) -> DataFrame:
    need = window if min_periods is None else min_periods
    f = _frame(-(window // 2), (window - 1) // 2) if center else _frame(-(window - 1), 0)
    return indexed.withColumn("value", F.when(F.count("value").over(f) >= need, F.avg("value").over(f)))


def smooth_mean(cube: DataFrame, kernel: int = 3) -> DataFrame:
    """Centred k x k box mean; every cell of the box must be present."""
    if kernel < 1 or kernel % 2 == 0:
        raise ValueError("kernel must be a positive odd number")
    h = kernel // 2
    up = W.partitionBy("time", "x_idx").orderBy("y_idx").rangeBetween(-h, h)
    across = W.partitionBy("time", "y_idx").orderBy("x_idx").rangeBetween(-h, h)
    cols = cube.withColumns({"_s": F.sum("value").over(up), "_n": F.count("value").over(up)})
    boxes = cols.withColumns({"_bs": F.sum("_s").over(across), "_bn": F.sum("_n").over(across)})
    full = F.when(F.col("_bn") == kernel * kernel, F.col("_bs") / F.col("_bn"))
    return boxes.withColumn("value", full).drop("_s", "_n", "_bs", "_bn")


def rolling_quantile(indexed: DataFrame, window: int, q: float, name: str = "threshold") -> DataFrame:
    if window < 1:
        raise ValueError("window must be at least 1")
    return indexed.withColumn(name, F.percentile("value", F.lit(q)).over(_frame(-(window - 1), 0)))


def rolling_tail_contrast(indexed: DataFrame, window: int, q: float = 0.8, min_periods: int = 5) -> DataFrame:
    """Variance of the values at or above the rolling quantile minus the window's variance."""
    f = _frame(-(window - 1), 0)
    cut = F.round(F.percentile("value", F.lit(q)).over(f), 9)
    step = indexed.withColumns(
        {"_n": F.count("value").over(f), "_v": F.var_pop("value").over(f), "_q": cut, "_w": F.collect_list("value").over(f)}
    )
    tail = F.filter("_w", lambda v: F.round(v, 9) >= F.col("_q"))
    n = F.size("_t").cast("double")
    m = F.aggregate("_t", F.lit(0.0), lambda a, v: a + v) / n
    ss = F.aggregate("_t", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m")))
    out = step.withColumn("_t", tail).withColumn("_m", F.when(F.size("_t") > 0, m))
    contrast = F.when((F.col("_n") >= min_periods) & (F.size("_t") > 0), ss / n - F.col("_v"))
    return out.withColumn("value", contrast).drop("_n", "_v", "_q", "_w", "_t", "_m")


def center_reference(cube: DataFrame) -> DataFrame:
    """Series at the centre cell (size // 2 on both axes): time, ref."""
    mid = cube.agg(
        F.floor((F.max("y_idx") + 1) / 2).alias("_cy"), F.floor((F.max("x_idx") + 1) / 2).alias("_cx")
    )
    at = (F.col("y_idx") == F.col("_cy")) & (F.col("x_idx") == F.col("_cx"))
    return cube.join(F.broadcast(mid), at).select("time", F.col("value").alias("ref"))


def with_center_reference(cube: DataFrame) -> DataFrame:
    """Each cell's value next to the centre cell's value of the same day."""
    return cube.join(center_reference(cube), "time", "left")


def rolling_corr_vs_center(cube: DataFrame, window_days: int = 90, min_t: int = 5) -> DataFrame:
    """Pearson r with the centre cell over the closed window [t - W, t].

    Windows that hold fewer than ``min_t`` timestamps of the axis are dropped.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    steps = axis(cube, "time", "t_idx").withColumn("_d", day(F.col("time")))
    # the axis alone: one row per day
    counted = steps.withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)).orderBy("_d").rangeBetween(-window_days, 0)))
    joined = with_center_reference(cube).join(counted.select("time", "_d", "_k"), "time")
    f = W.partitionBy(*CELL).orderBy("_d").rangeBetween(-window_days, 0)
    both = F.col("value").isNotNull() & F.col("ref").isNotNull()
    x, y = F.when(both, F.col("value")), F.when(both, F.col("ref"))
    spread = F.sqrt(F.var_pop(x).over(f) * F.var_pop(y).over(f))
    r = F.when(
        (F.count(x).over(f) >= 2) & (spread > 1e-12), F.try_divide(F.covar_pop(x, y).over(f), spread)
    )
    return joined.withColumn("r", r).where(F.col("_k") >= min_t).select("time", *CELL, F.col("r").alias("value"))


def time_windows(cube: DataFrame, window: int | str | None, stride_steps: int = 1) -> DataFrame:
    """Closed hopping windows: one row per (window end, day of the axis inside it).

    Built on the time axis alone by expanding each end to its W + 1 calendar
    days, so it meets the cube in an equi-join on ``time``.
    """
    steps = axis(cube, "time", "t_idx")
    if window is None:
        last = cube.agg(F.max("time")).scalar()
        return steps.select(last.alias("window_end"), "time")
    days = C.parse_days(window)
    if days < 1:
        raise ValueError("window must be positive")
    ends = steps.where(F.col("t_idx") % stride_steps == 0).select(F.col("time").alias("window_end"))
    spread = ends.select(
        "window_end", F.explode(F.sequence(F.date_sub("window_end", days), F.col("window_end"))).alias("time")
    )
    return spread.join(steps.select("time"), "time", "left_semi").select("window_end", "time")


def stride_periods(cube: DataFrame, span: int | str) -> int:
    """Periods of the median time step in ``span`` (bounded probe on the axis)."""
    if isinstance(span, int):
        if span < 1:
            raise ValueError("stride must be at least 1")
        return span
    step = median_step_days(cube).first()[0]
    return max(1, round(C.parse_days(span) / step)) if step else 1


def median_step_days(cube: DataFrame) -> DataFrame:
    """Median distance between neighbouring timestamps of the axis, in days (one row)."""
    steps = axis(cube, "time", "t_idx")
    nxt = steps.select((F.col("t_idx") - 1).alias("t_idx"), F.col("time").alias("_next"))
    return steps.join(nxt, "t_idx").agg(F.median(F.datediff("_next", "time")).alias("step_days"))


def lag_periods(cube: DataFrame, lag: int | str, floor: int | None = None) -> int:
    """A lag such as 3 or ``7D`` as grid periods; ``floor=1`` for state lags."""
    if isinstance(lag, int):
        periods = lag
    else:
        days = C.parse_days(lag)
        step = median_step_days(cube).first()[0]
        periods = 0 if days == 0 or not step else round(days / step)
    return periods if floor is None else max(periods, floor)


def rolling_split_synchrony(
    cube: DataFrame, window_days: int = 90, min_t: int = 5, b: float = 0.5, output_stride: int = 1,
    lower: str | None = None, upper: str | None = None,
) -> DataFrame:
    """Spearman with the centre cell inside the joint lower and the joint upper set.

    With ``lower`` / ``upper`` the two sets come from two variables of the cube.
    """
    if not 0.0 < b <= 0.5:
        raise ValueError("b must be in (0, 0.5]")
    if (lower is None) != (upper is None):
        raise ValueError("lower and upper go together")
    if lower is not None and lower != upper:
        low = rolling_split_synchrony(select_variable(cube, lower), window_days, min_t, b, output_stride)
        up = rolling_split_synchrony(select_variable(cube, upper), window_days, min_t, b, output_stride)
        keys = ["window_end", *CELL]
        both = low.select(*keys, "bottom_synchrony").join(up.select(*keys, "top_synchrony"), keys, "inner")
        return both.withColumn("bottom_minus_top", F.col("bottom_synchrony") - F.col("top_synchrony"))
    windows = time_windows(cube, window_days, output_stride)
    enough = windows.groupBy("window_end").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_t)
    windows = windows.join(enough.select("window_end"), "window_end", "left_semi")
    paired = with_center_reference(cube).join(windows, "time")
    key = ["window_end", *CELL]
    # one row per cell and day: each partition below is bounded by the window length
    w = W.partitionBy(*key)
    both = F.col("value").isNotNull() & F.col("ref").isNotNull()
    x, y = F.when(both, F.col("value")), F.when(both, F.col("ref"))
    cut = lambda c, q: F.round(F.percentile(c, F.lit(q)).over(w), 9)
    sided = paired.withColumns(
        {"_lx": cut(x, b), "_ly": cut(y, b), "_ux": cut(x, 1 - b), "_uy": cut(y, 1 - b), "_n": F.count(x).over(w)}
    )
    vx, vy = F.round("value", 9), F.round("ref", 9)
    side = F.array_compact(
        F.array(
            F.when(both & (vx <= F.col("_lx")) & (vy <= F.col("_ly")), "low"),
            F.when(both & (vx > F.col("_ux")) & (vy > F.col("_uy")), "up"),
        )
    )
    chosen = sided.where(F.col("_n") >= min_t).select(*key, "value", "ref", F.explode(side).alias("side"))
    ranked = chosen.select(
        *key, "side", average_rank("value", [*key, "side"]).alias("u"), average_rank("ref", [*key, "side"]).alias("v")
    )
    score = lambda s: C.pearson(
        F.when(F.col("side") == s, F.col("u")), F.when(F.col("side") == s, F.col("v"))
    )
    n = lambda s: F.count_if(F.col("side") == s) >= min_t
    scores = ranked.groupBy(*key).agg(
        F.when(n("low"), score("low")).alias("bottom_synchrony"), F.when(n("up"), score("up")).alias("top_synchrony")
    )
    frame = paired.select(*key).distinct()
    return frame.join(scores, key, "left").withColumn(
        "bottom_minus_top", F.col("bottom_synchrony") - F.col("top_synchrony")
    )


WINDOW_ROWS = 100_000


def rolling_pairwise_stat(cube: DataFrame, stat, window_days: int, min_t: int = 5) -> DataFrame:
    """User statistic ``stat(x, y) -> float`` on each window; a cell's series is packed once, not once a window.

    ``stat`` sees two aligned pandas Series in time order with missing values dropped by pair. The window ends
    (a number a day of the axis) are collected.
    """
    held = time_windows(cube, window_days).groupBy("window_end").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_t)
    ends = np.array(sorted(r[0] for r in held.select(F.unix_date("window_end")).collect()), np.int64)
    row = F.struct(F.unix_date(F.col("time").cast("date")).alias("d"), F.col("value").cast("double").alias("value"), F.col("ref").cast("double").alias("ref"))
    series = with_center_reference(cube).groupBy(*CELL).agg(F.array_sort(F.collect_list(row)).alias("_s")).select(*CELL, "_s.d", "_s.value", "_s.ref")
    names = ["_end", *CELL, "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for *cell, d, x, y in b[[*CELL, "d", "value", "ref"]].itertuples(index=False, name=None):
                x, y = np.asarray(x, float), np.asarray(y, float)
                ok = ~(np.isnan(x) | np.isnan(y))
                for end, i, j in zip(ends, np.searchsorted(d, ends - window_days), np.searchsorted(d, ends, "right")):
                    if i < j:
                        keep = ok[i:j]
                        made.append((end, *cell, float(stat(pd.Series(x[i:j][keep]), pd.Series(y[i:j][keep])))))
                if len(made) >= WINDOW_ROWS:
                    yield pd.DataFrame(made, columns=names)
                    made = []
            if made:
                yield pd.DataFrame(made, columns=names)

    kinds = dict(cube.dtypes)
    out = series.mapInPandas(run, "_end int, " + ", ".join(f"{c} {kinds[c]}" for c in CELL) + ", value double")
    return out.select(F.date_from_unix_date("_end").alias("window_end"), *CELL, "value")
