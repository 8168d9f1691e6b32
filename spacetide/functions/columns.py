"""Column expressions shared by all operators. All are safe under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become NULL, the one missing marker used here."""
    c = as_col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either side is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_true(c: Column) -> Column:
    """Three-valued logic folded to two: NULL counts as False."""
    return F.coalesce(c, F.lit(False))


def pearson(x: str | Column, y: str | Column, eps: float = 1e-12) -> Column:
    """Pearson r as an aggregate; pairs with a missing side are skipped.

    NULL for constant series (``corr`` divides by zero under ANSI mode).
    """
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    spread = F.sqrt(vx * vy)
    return F.when(spread > eps, F.try_divide(F.covar_pop(x, y), spread))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def place_distance(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Great-circle km when all four values look like degrees, else Euclidean."""
    looks_geographic = (
        (F.abs(x1) <= 180) & (F.abs(x2) <= 180) & (F.abs(y1) <= 90) & (F.abs(y2) <= 90)
    )
    return F.when(looks_geographic, haversine_km(y1, x1, y2, x2)).otherwise(
        F.hypot(y2 - y1, x2 - x1)
    )


def log10_clipped(c: str | Column, floor: float = 1e-9) -> Column:
    return F.log10(F.greatest(as_col(c), F.lit(floor)))


def log1p_clipped(c: str | Column) -> Column:
    return F.log1p(F.greatest(as_col(c), F.lit(0.0)))


def equivalent_radius(area: str | Column) -> Column:
    return F.sqrt(F.greatest(as_col(area), F.lit(0.0)) / F.lit(3.141592653589793))


def slenderness(duration_days: str | Column, area: str | Column) -> Column:
    """Days per kilometre of equivalent width; the width has a floor of 0.1 km."""
    return as_col(duration_days) / F.greatest(2 * equivalent_radius(area), F.lit(0.1))


def slug(c: str | Column) -> Column:
    """Lower-case words joined by underscores."""
    text = F.regexp_replace(F.lower(F.trim(as_col(c))), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def place_label(y: str | Column, x: str | Column) -> Column:
    """``y=..,x=..`` with integral values written without a decimal point."""

    def short(c: Column) -> Column:
        whole = c == F.floor(c)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))

    return F.concat(F.lit("y="), short(as_col(y)), F.lit(",x="), short(as_col(x)))


def pair_label(a: str | Column, b: str | Column) -> Column:
    return F.concat(as_col(a), F.lit("__"), as_col(b))


def comma_list(values: str | Column) -> Column:
    """Sorted distinct values joined by commas (aggregate over a small code set)."""
    return F.concat_ws(",", F.array_sort(F.collect_set(as_col(values))))


def midnight(c: str | Column) -> Column:
    """Text or timestamp to DATE; text that is no date becomes NULL."""
    return F.to_date(F.try_to_timestamp(as_col(c).cast("string")))


def span_days(c: str | Column) -> Column:
    """Days in a span such as ``7D`` or ``1Y`` (a year is 365 days); NULL if malformed."""
    text = F.upper(F.trim(as_col(c).cast("string")))
    number = F.regexp_extract(text, r"^(-?\d+)[DY]?$", 1).try_cast("int")
    return F.when(text.endswith("Y"), number * 365).otherwise(number)


def parse_days(span: str | int | None) -> int:
    """Driver-side twin of :func:`span_days` for operator parameters."""
    if span is None:
        return 0
    if isinstance(span, int):
        return span
    text = span.strip().upper()
    if text[-1:] not in {"D", "Y"}:
        raise ValueError(f"a span needs the unit D or Y, got {span!r}")
    return int(text[:-1]) * (365 if text[-1] == "Y" else 1)


def choose(c: Column, bins: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """First label whose condition holds."""
    out = None
    for condition, label in bins:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def season(month: str | Column) -> Column:
    m = as_col(month)
    return choose(
        m,
        [
            (m.isin(12, 1, 2), "winter"),
            (m.isin(3, 4, 5), "spring"),
            (m.isin(6, 7, 8), "summer"),
        ],
        "fall",
    )


def duration_bin(n: str | Column) -> Column:
    n = as_col(n)
    return choose(n, [(n <= 1, "1"), (n <= 3, "2-3"), (n <= 7, "4-7")], "8+")


def time_bin(rel_t: str | Column) -> Column:
    """Thirds of relative time, right-closed, as early / middle / late."""
    t = as_col(rel_t)
    return choose(
        t,
        [
            ((t > -0.001) & (t <= 1 / 3), "early"),
            ((t > 1 / 3) & (t <= 2 / 3), "middle"),
            ((t > 2 / 3) & (t <= 1.001), "late"),
        ],
        None,
    )


YEAR_EDGES = (1999, 2004, 2008, 2012, 2016, 2022)


def year_block(year: str | Column, edges: Sequence[int] = YEAR_EDGES) -> Column:
    """Zero-based index of the right-closed year interval (lowest edge included)."""
    y = as_col(year)
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = (y >= edges[i]) if i == 0 else (y > edges[i])
        out = F.when(low & (y <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def region_of(lon: str | Column, lat: str | Column, *, bounded: bool = True) -> Column:
    """Coarse region label from a centroid; rules apply in this order."""
    lon, lat = as_col(lon), as_col(lat)
    rules = [
        ((lat >= 50) & lon.between(-170, -130), "alaska"),
        (lat.between(18, 23) & lon.between(-161, -154), "hawaii"),
    ]
    if bounded:
        rules.append((~(lon.between(-125, -66) & lat.between(24, 50)), "outside_conus"))
    rules += [(lon < -112, "west"), (lon < -96, "intermountain"), (lon < -84, "central")]
    return choose(lon, rules, "east")


def spatial_bucket(lon: str | Column, lat: str | Column, size: float = 1.0) -> Column:
    """Degree tile name such as ``n040_w0106``."""
    if size <= 0:
        raise ValueError("size must be positive")

    def part(c: Column, positive: str, negative: str, width: int) -> Column:
        f = F.floor(c / F.lit(float(size)))
        return F.concat(
            F.when(f >= 0, positive).otherwise(negative),
            F.lpad(F.abs(f).cast("string"), width, "0"),
        )

    return F.concat(
        part(as_col(lat), "n", "s", 3), F.lit("_"), part(as_col(lon), "e", "w", 4)
    )


def all_present(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out
