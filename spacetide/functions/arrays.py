"""Higher-order expressions over one ordered array per row.

The arrays hold one entity's daily values, so their length is bounded by the
number of days on record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Higher-order functions re-evaluate whatever a lambda mentions for every
    element; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered(order: str | Column, value: Column) -> Column:
    """Aggregate: values as an array in the order of ``order``."""
    order = F.col(order) if isinstance(order, str) else order
    packed = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(packed, lambda s: s["v"])


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def mean(arr: Column) -> Column:
    return F.try_divide(total(arr), F.size(arr).cast("double"))


def interp(arr: Column, fraction: Column | float) -> Column:
    """Linear interpolation at a fraction of an evenly spaced array (ends clamped)."""
    fraction = F.lit(fraction) if isinstance(fraction, (int, float)) else fraction

    def at(s: Column) -> Column:
        last = F.size(s["a"]) - 1
        lo = F.floor(s["p"]).cast("int")
        low = F.get(s["a"], lo)
        return low + (F.get(s["a"], F.least(lo + 1, last)) - low) * (s["p"] - lo)

    return let(arr, lambda a: let(F.struct(a.alias("a"), F.round(fraction * (F.size(a) - 1), 9).alias("p")), at))


def diff(arr: Column) -> Column:
    """v[i+1] - v[i]; a single value gives [0.0]."""

    def steps(v: Column) -> Column:
        n = F.greatest(F.size(v) - 1, F.lit(0))
        return F.when(n > 0, F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), lambda b, a: b - a)).otherwise(F.array(F.lit(0.0)))

    return let(arr, steps)


def gradient(arr: Column) -> Column:
    """Central differences inside, one-sided differences at both ends."""

    def slopes(v: Column) -> Column:
        last = F.size(v) - 1

        def at(i: Column) -> Column:
            lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, last)
            return (F.get(v, hi) - F.get(v, lo)) / (hi - lo)

        return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), at))

    return let(arr, slopes)


def trapezoid(values: Column, times: Column) -> Column:
    """Area under values over times."""
    idx = F.when(F.size(values) > 1, F.sequence(F.lit(1), F.size(values) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(
        idx,
        F.lit(0.0),
        lambda acc, i: acc
        + (F.get(times, i) - F.get(times, i - 1)) * (F.get(values, i) + F.get(values, i - 1)) / 2,
    )


def run_starts(flags: Column) -> Column:
    """Zero-based positions where a boolean array turns true."""

    def starts(f: Column) -> Column:
        idx = F.sequence(F.lit(0), F.size(f) - 1)
        return F.filter(idx, lambda i: F.get(f, i) & ((i == 0) | ~F.coalesce(F.get(f, i - 1), F.lit(False))))

    return let(flags, starts)


def quantile(arr: Column, q: float) -> Column:
    """Interpolated quantile of the array's values."""
    return interp(F.array_sort(arr), q)
