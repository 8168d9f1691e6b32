"""Exact order statistics that never gather a whole group in one task.

``percentile``, ``median`` and a ranking window put every row (or every distinct
value) of a group into one task. That is fine for one cell's daily series, whose
length is bounded by the calendar, and wrong for a region or a whole population.
The functions below count equal values first, cut the value range at values
chosen by their hash, turn per-bucket counts into offsets, and finish inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(value: str | Column, partition: Sequence[str | Column]) -> Column:
    """1-based rank with ties averaged, for partitions bounded by the time axis."""
    value = F.col(value) if isinstance(value, str) else value
    ordered = W.partitionBy(*partition).orderBy(value)
    ties = W.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def percent_rank_average(value: str | Column, partition: Sequence[str | Column]) -> Column:
    """Average rank divided by the number of present values."""
    value = F.col(value) if isinstance(value, str) else value
    present = F.count(value).over(W.partitionBy(*partition))
    return F.when(value.isNotNull(), average_rank(value, [*partition, value.isNull()]) / present)


#: One distinct value in so many becomes a cut point; a group with fewer values is mostly one bucket.
CUT_RATE = 4096


def _buckets(df: DataFrame) -> int:
    """As many as the session has shuffle partitions."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def cut_points(present: DataFrame, value: str, by: Sequence[str], buckets: int) -> DataFrame:
    """by..., ``_cuts``: fewer than ``buckets`` ascending values per group; groups without cuts may be missing.

    The values whose hash falls into one of CUT_RATE slots, thinned: a group is cut evenly wherever its values lie, and the cuts
    depend on the values alone. Plans that cut twice (and stages that run again) must cut alike, which a sketch does not:
    its result depends on the order in which its parts are merged.
    """
    drawn = present.where(F.pmod(F.xxhash64(value), F.lit(CUT_RATE)) == 0).groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("_drawn"))
    step = F.ceil(F.size("_drawn") / F.lit(float(buckets - 1)))
    return drawn.select(*by, F.filter("_drawn", lambda c, i: (i + 1) % step == 0).alias("_cuts"))


def number_below(ascending: str | Column, value: Column, most: int) -> Column:
    """How many of fewer than ``most`` ascending values lie below ``value``, by halving: a row costs log2 of their number, not their number."""
    ascending = F.col(ascending) if isinstance(ascending, str) else ascending
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ascending, at + step - 1) < value, at + step).otherwise(at))


def ordered_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: ``cnt`` and ``cum_before`` (rows strictly below).

    Columns: by..., value, cnt, cum_before, total. The counts are exact for any cuts of ``cut_points``.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    buckets = _buckets(df)
    counts = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    cuts = cut_points(present, value, by, buckets)
    counts = counts.join(cuts, by, "left") if by else counts.withColumn("_cuts", cuts.scalar())
    counts = counts.withColumn("_bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(number_below("_cuts", F.col(value), buckets))).drop("_cuts")
    per_bucket = counts.groupBy(*by, "_bucket").agg(F.sum("cnt").alias("_n"))
    run = W.partitionBy(*by).orderBy("_bucket")
    offsets = per_bucket.select(
        *by,
        "_bucket",
        (F.sum("_n").over(run) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*by)).alias("total"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    return (
        counts.join(offsets, [*by, "_bucket"])
        .withColumn("cum_before", F.col("_offset") + F.sum("cnt").over(inside) - F.col("cnt"))
        .select(*by, value, "cnt", "cum_before", "total")
    )


def quantile_table(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one row per group with columns ``q0, q1, ..``."""
    by = list(by)
    oc = ordered_counts(df, value, by)
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos"))
            for i, p in enumerate(probs)
        ]
    )
    hit = oc.select(
        *by,
        F.col(value).alias("_v"),
        "cnt",
        "cum_before",
        F.explode(targets).alias("t"),
    ).select(*by, "_v", "cnt", "cum_before", "t.i", F.round("t.pos", 9).alias("pos"))
    holds = lambda k: (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("cnt"))
    lo, hi = F.floor("pos"), F.ceil("pos")
    aggs = []
    for i in range(len(probs)):
        mine = F.col("i") == i
        low = F.max(F.when(mine & holds(lo), F.col("_v")))
        high = F.max(F.when(mine & holds(hi), F.col("_v")))
        frac = F.max(F.when(mine, F.col("pos") - lo))
        aggs.append((low + (high - low) * frac).alias(f"q{i}"))
    return hit.where(holds(lo) | holds(hi)).groupBy(*by).agg(*aggs)


def weighted_medians(df: DataFrame, value: str, kinds: Sequence[Column]) -> DataFrame:
    """One row, ``medians``: the exact interpolated median of the rows of each kind. The kinds may overlap; a row is shuffled once for all of them."""
    names = [f"_c{i}" for i in range(len(kinds))]
    present = df.where(F.col(value).isNotNull())
    buckets = _buckets(df)
    counts = present.groupBy(value).agg(*[F.count_if(k).alias(n) for n, k in zip(names, kinds)])
    counts = counts.withColumn("_cuts", cut_points(present, value, [], buckets).scalar())
    counts = counts.withColumn("_bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(number_below("_cuts", F.col(value), buckets))).drop("_cuts")
    per_bucket = counts.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names])
    run, whole = W.partitionBy(F.lit(0)).orderBy("_bucket"), W.partitionBy(F.lit(0))  # a row a bucket
    offsets = per_bucket.select("_bucket", *[(F.sum(n).over(run) - F.col(n)).alias(f"{n}_o") for n in names], *[F.sum(n).over(whole).alias(f"{n}_t") for n in names])
    inside = W.partitionBy("_bucket").orderBy(value)
    placed = counts.join(offsets, "_bucket").withColumns({f"{n}_b": F.col(f"{n}_o") + F.sum(n).over(inside) - F.col(n) for n in names})
    found = []
    for n in names:
        before, mid = F.col(f"{n}_b"), (F.col(f"{n}_t") - 1) / 2
        at = lambda k: F.max(F.when((before <= k) & (k < before + F.col(n)), F.col(value)))  # noqa: B023, E731
        found.append(at(F.floor(mid)) + (at(F.ceil(mid)) - at(F.floor(mid))) * 0.5)
    return placed.agg(F.array(*found).alias("medians"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole column as plain numbers (one row to the driver)."""
    row = quantile_table(df, value, probs).first()
    return [None] * len(probs) if row is None else [row[f"q{i}"] for i in range(len(probs))]


def column_quantiles(df: DataFrame, probs: dict[str, Sequence[float]]) -> dict[str, list[float]]:
    """Exact quantiles of several columns in one pass (one row per column to the driver)."""
    every = sorted({p for ps in probs.values() for p in ps})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in probs]).unpivot([], list(probs), "_metric", "_value")
    rows = {r["_metric"]: r for r in quantile_table(long, "_value", every, ["_metric"]).collect()}
    pick = lambda c, p: rows[c][f"q{every.index(p)}"] if c in rows else None
    return {c: [pick(c, p) for p in ps] for c, ps in probs.items()}


def with_average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (), pct: bool = False) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` over a group of any size."""
    by = list(by)
    oc = ordered_counts(df, value, by)
    rank = F.col("cum_before") + (F.col("cnt") + 1) / 2.0
    if pct:
        rank = rank / F.col("total")
    return df.join(oc.select(*by, value, rank.alias(name)), [*by, value], "left")


def quantile_bin(value: str | Column, edges: Sequence[float]) -> Column:
    """Zero-based right-closed bin between interpolated quantile edges (outer edges dropped)."""
    value = F.col(value) if isinstance(value, str) else value
    inner = sorted(set(edges))[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + F.when(value > F.lit(float(e)), 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def qcut(df: DataFrame, value: str, q: int, name: str) -> DataFrame:
    """Equal-frequency bins; duplicate edges collapse. Edges are bounded by ``q``."""
    edges = quantiles(df, value, [i / q for i in range(q + 1)])
    edges = [round(e, 9) for e in edges if e is not None]
    return df.withColumn(name, quantile_bin(F.round(F.col(value), 9), edges))
