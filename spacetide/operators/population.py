"""Population reports and cohort summaries over event traits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ranking import number_below, ordered_counts, qcut, quantile_table
from ..session import cut_lineage


def event_summary(daily: DataFrame, key: str = "fire_id", day: str = "timestamp") -> DataFrame:
    return daily.groupBy(key).agg(
        F.min(day).alias("start"), F.max(day).alias("end"), (F.datediff(F.max(day), F.min(day)) + 1).alias("duration_days"), F.count(F.lit(1)).alias("n_rows")
    )


def population_report(traits: DataFrame, area: str = "total_area_km2", hours: str = "duration_hours") -> DataFrame:
    """Overall, per year, per region and per region-year in one pass.

    Exact medians of the overall and per-region rows come from the distributed
    form and are joined to the grouping-set rows.
    """
    sets = traits.select("year", "region", F.col("year").alias("_year"), area, (F.col(hours) / 24.0).alias("_d")).groupingSets(
        [[], ["year"], ["region"], ["region", "year"]], "region", "year"
    )
    report = sets.agg(
        F.grouping_id("region", "year").cast("int").alias("level"), F.count(F.lit(1)).alias("n_fires"), F.countDistinct("_year").alias("n_years"),
        F.min("_year").alias("min_year"), F.max("_year").alias("max_year"),
        F.sum(area).alias("total_area_km2"), F.avg(area).alias("mean_area_km2"), F.max(area).alias("max_area_km2"), F.avg("_d").alias("mean_duration_days"),
        F.max("_d").alias("max_duration_days"),
    )
    long = traits.select("region", F.col(area).cast("double").alias("median_area_km2"), (F.col(hours) / 24.0).alias("median_duration_days"))
    names = ["median_area_km2", "median_duration_days"]
    long = long.unpivot(["region"], names, "_metric", "_value").where("_value is not null")
    each = [F.max(F.when(F.col("_metric") == c, F.col("q0"))).alias(c) for c in names]
    per_region = quantile_table(long, "_value", [0.5], ["region", "_metric"]).groupBy(F.col("region").alias("_r"), F.lit(1).alias("_l")).agg(*each)
    overall = quantile_table(long, "_value", [0.5], ["_metric"]).groupBy(F.lit(None).cast("string").alias("_r"), F.lit(3).alias("_l")).agg(*each)
    medians = per_region.unionByName(overall)
    match = (F.col("level") == F.col("_l")) & F.col("region").eqNullSafe(F.col("_r"))
    return report.join(medians, match, "left").drop("_r", "_l")


def quantile_report(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """One row per metric with exact quantiles; all metrics share the pass."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "metric", "value")
    q = quantile_table(long, "value", probs, ["metric"])
    return q.select("metric", *[F.col(f"q{i}").alias(f"p{int(round(p * 100)):02d}") for i, p in enumerate(probs)])


def metric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, min, median, mean and max of several metrics as rows."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "metric", "value").where("value is not null")
    sums = long.groupBy("metric").agg(F.count("value").alias("n"), F.min("value").alias("minimum"), F.avg("value").alias("mean"), F.max("value").alias("maximum"))
    return sums.join(quantile_table(long, "value", [0.5], ["metric"]).withColumnRenamed("q0", "median"), "metric")


def fold_summary(scores: DataFrame, by: Sequence[str], value: str = "r2") -> DataFrame:
    """Mean with 2.5 and 97.5 % quantiles over folds (a fold table is small: folds times models)."""
    return scores.groupBy(*by).agg(
        F.avg(value).alias("mean_r2"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("n_folds"),
    )


def category_fingerprints(df: DataFrame, category: str, traits: Sequence[str]) -> DataFrame:
    """Median trait per category, then z-scored over the categories (ddof = 0)."""
    long = df.select(category, *[F.col(t).cast("double") for t in traits]).unpivot([category], list(traits), "trait", "value")
    med = quantile_table(long, "value", [0.5], [category, "trait"]).withColumnRenamed("q0", "median")
    w = W.partitionBy("trait")  # one row per category
    sd = F.stddev_pop("median").over(w)
    return med.withColumn("z", F.when(sd > 1e-12, (F.col("median") - F.avg("median").over(w)) / sd))


def availability(df: DataFrame, columns: Sequence[str], zone: str | None = None, key: str = "fire_id", flag: str = "climate_available") -> DataFrame:
    """Per-variable present counts, or rows / events / availability rate by zone."""
    if zone is not None:
        return df.groupBy(zone).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_fires"), F.avg(F.col(flag).cast("double")).alias("availability_rate"))
    counts = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    return counts.unpivot(["_n"], list(columns), "variable", "present").select("variable", "present", (F.col("_n") - F.col("present")).alias("missing"))


def pixel_area_estimate(daily: DataFrame, area: str, pixels: str) -> DataFrame:
    """Median area per pixel over rows with pixels; any number of rows."""
    valid = daily.where((F.col(pixels) > 0) & F.col(area).isNotNull()).select((F.col(area) / F.col(pixels)).alias("_a"))
    return quantile_table(valid, "_a", [0.5]).withColumnRenamed("q0", "pixel_area_km2")


def event_aligned_quantiles(df: DataFrame, value: str, offset: str, probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Per offset: count and quantiles. 0.5 interpolates; others take the element at
    the half-to-even rounded position (n - 1) q of the sorted values."""
    rows = df.where(F.col(value).isNotNull() & F.col(offset).isNotNull())
    oc = ordered_counts(rows, value, [offset])
    aggs = [F.max("total").alias("count")]
    for p in probs:
        last = F.col("total") - 1
        holds = lambda k: (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("cnt"))
        pick = lambda k: F.max(F.when(holds(k), F.col(value)))
        name = f"q{int(p * 100):02d}"
        if p == 0.5:
            aggs.append(((pick(F.floor(last / 2)) + pick(F.ceil(last / 2))) / 2).alias(name))
        else:
            aggs.append(pick(F.bround(last * F.lit(p), 0).cast("bigint")).alias(name))
    return oc.groupBy(offset).agg(*aggs)


def extreme_pairs_in_bins(df: DataFrame, size: str, score: str, key: str = "fire_id", bins: int = 40, least: int = 20) -> DataFrame:
    """Smallest and largest score among events of similar size; the widest such pair."""
    binned = qcut(df, size, bins, "_bin")
    at = F.struct(F.col(score), F.col(key))
    per = binned.where(F.col(score).isNotNull()).groupBy("_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("lo"), F.max(at).alias("hi")
    )
    gap = F.round(F.col(f"hi.{score}") - F.col(f"lo.{score}"), 9)
    return per.where(F.col("_n") >= least).select(
        F.col("_bin").alias("bin"), F.col(f"lo.{key}").alias("low_id"), F.col(f"hi.{key}").alias("high_id"), gap.alias("gap")
    ).orderBy(F.desc("gap"), "bin").limit(1)


MEDOID_CELLS = 200_000
MEDOID_PAIRS = 1 << 20


def _cuts_by_spread(spreads: Sequence[float], cells: int) -> list[int]:
    """Cuts a dimension, their product at most ``cells``, so that all have steps of one length; 1000 at most."""
    cuts, left, room = [1] * len(spreads), sorted(range(len(spreads)), key=lambda i: spreads[i]), float(cells)
    while left:
        widths = [max(spreads[i], 1e-12) for i in left]
        step = (float(np.prod([w / widths[0] for w in widths])) / room) ** (1 / len(left))
        n = int(min(1000, max(1, 1 / step)))
        cuts[left[0]] = n
        room, left = max(1.0, room / n), left[1:]
    return cuts


def _thinned(values: Sequence[float], n: int) -> list[float]:
    """At most ``n`` - 1 of ascending values, those nearest below the ends of ``n`` equal steps and all of few."""
    values = np.unique(np.asarray(values, float))
    if len(values) < n:
        return values.tolist()
    at = np.searchsorted(values, np.linspace(values[0], values[-1], n + 1)[1:-1])
    return np.unique(values[at]).tolist()


def _sum_bounds(p: np.ndarray, n: np.ndarray, m: np.ndarray, h: np.ndarray, c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each point's distance sum to all cells: ``n`` points each, their mean, largest offsets and summed products of offsets."""
    every = range(p.shape[1])
    off = [p[:, i : i + 1] - m[None, :, i] for i in every]
    d = np.sqrt(sum(o * o for o in off))
    away = [np.divide(o, d, out=np.zeros_like(d), where=d > 0) for o in off]
    spread = sum(c[i, i] for i in every)
    along = sum((1 if i == j else 2) * c[i, j] * away[i] * away[j] for i, j in c)
    across = np.clip(spread - along, 0, None)
    reach = sum(np.abs(away[i]) * h[:, i] for i in every)
    low = d @ n
    wide = np.sqrt(d * d * n * n + spread * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.where(d > reach, np.minimum(wide, n * d + across / (2 * (d - reach))), wide)
    return low, high.sum(axis=1)


def medoid(df: DataFrame, traits: Sequence[str], key: str = "fire_id", by: str | None = None, candidates: int | None = None, cuts: int | None = None) -> DataFrame:
    """Row with the smallest summed Euclidean distance to its cohort (smallest key on ties).

    Exact without comparing every pair. Points are summarised in grid cells
    (count n, mean m, mean squared spread v). For a point p, the sum over a
    cell lies between n|p - m| and n sqrt(|p - m|^2 + v), so one pass bounds
    every point's total, and only points whose lower bound beats the best upper
    bound are summed exactly. Where the point lies outside the cell's box, the upper
    bound is n d + s / 2 (d - r): s sums the squares across the line to the mean, r is
    the box's half diagonal seen from it. ``candidates`` restricts the cohort to its
    first rows by key, as the table build does.

    Cells are about as long as wide: a trait gets cuts in proportion to its spread. At
    most MEDOID_CELLS summaries reach the tasks, which compare MEDOID_PAIRS at a time.
    """
    traits = list(traits)
    spark = df.sparkSession
    cohort = F.lit("all") if by is None else F.col(by).cast("string")
    pts = df.select(cohort.alias("_c"), F.col(key).alias("_key"), *[F.col(t).cast("double") for t in traits]).dropna(subset=traits)
    if candidates is not None:
        pts = pts.withColumn("_r", F.row_number().over(W.partitionBy("_c").orderBy("_key"))).where(F.col("_r") <= candidates).drop("_r")
    # equal vectors are one point with a weight; the smallest key speaks for them
    merged = cut_lineage(pts.groupBy("_c", *traits).agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key")), "medoid")
    n_cohorts = merged.agg(F.approx_count_distinct("_c")).first()[0]
    per_cohort = max(16, (cuts or MEDOID_CELLS // max(1, n_cohorts)))
    thousandths = [i / 1000 for i in range(1, 1000)]
    spread = merged.agg(*[F.percentile_approx(t, thousandths, 10_000).alias(t) for t in traits]).first()  # 999 numbers a trait
    kind = dict(merged.dtypes)["_key"]
    shape = "_c string, " + ", ".join(f"`{t}` double" for t in traits) + f", _n long, _key {kind}, low double, high double"

    def narrowed(left: DataFrame, cells: int) -> DataFrame:
        """The points of ``left`` that can still win, by a grid of so many cells a cohort."""
        shares = _cuts_by_spread([(spread[t] or [0.0])[-1] - (spread[t] or [0.0])[0] for t in traits], cells)
        edges = {t: _thinned(spread[t] or [0.0], n) for t, n in zip(traits, shares)}
        slot = lambda t: number_below(F.lit(edges[t]), F.col(t), len(edges[t]) + 1)
        celled = merged.select("*", *[slot(t).alias(f"_s{i}") for i, t in enumerate(traits)])
        w, dims = F.col("_n"), range(len(traits))
        mean = [F.sum(F.col(t) * w) / F.sum(w) for t in traits]
        pairs = [(i, j) for i in dims for j in range(i, len(traits))]
        middle = celled.groupBy("_c", *[f"_s{i}" for i in dims]).agg(F.sum(w).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(mean)])
        off = [F.col(t) - F.col(f"m{i}") for i, t in enumerate(traits)]
        stats = celled.join(middle, ["_c", *[f"_s{i}" for i in dims]]).groupBy("_c", *[f"_s{i}" for i in dims]).agg(
            F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in dims], *[F.max(F.abs(off[i])).alias(f"h{i}") for i in dims],
            *[F.sum(off[i] * off[j] * w).alias(f"c{i}_{j}") for i, j in pairs],
        )
        summaries = stats.toPandas()  # at most MEDOID_CELLS rows of summaries
        book = {
            c: (g["n"].to_numpy(float), g[[f"m{i}" for i in dims]].to_numpy(float), g[[f"h{i}" for i in dims]].to_numpy(float), {p: g[f"c{p[0]}_{p[1]}"].to_numpy(float) for p in pairs})
            for c, g in summaries.groupby("_c")
        }
        shared = spark.sparkContext.broadcast(book)

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for c, g in b.groupby("_c"):
                    step = max(1, MEDOID_PAIRS // len(shared.value[c][0]))
                    for lo in range(0, len(g), step):
                        part = g.iloc[lo : lo + step]
                        low, high = _sum_bounds(part[traits].to_numpy(float), *shared.value[c])
                        yield part.assign(low=low, high=high)

        bounded = cut_lineage(left.mapInPandas(bounds, shape), "medoid-bounds")
        best = bounded.groupBy("_c").agg(F.min("high").alias("_best"))
        return bounded.join(best, "_c").where(F.col("low") <= F.col("_best") * (1 + 1e-9) + 1e-6).select(*merged.columns)

    # a coarse grid for all points, the fine one for those it leaves
    alive = narrowed(narrowed(merged, max(16, per_cohort // 32)), per_cohort)
    alive = cut_lineage(alive.select("_c", "_key", *[F.col(t).alias(f"_a_{t}") for t in traits]), "medoid-alive")
    # survivors meet their cohort's points on salted blocks; sums combine before the shuffle
    blocks = 32
    a = alive.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = merged.select("_c", "_n", *traits, F.pmod(F.xxhash64(*traits), F.lit(blocks)).cast("int").alias("_b"))
    sq = sum((F.pow(F.col(f"_a_{t}") - F.col(t), F.lit(2.0)) for t in traits), F.lit(0.0))
    total = b.join(a, ["_c", "_b"]).groupBy("_c", "_key").agg(F.round(F.sum(F.sqrt(sq) * F.col("_n")), 6).alias("total_distance"))
    pick = total.groupBy("_c").agg(F.min(F.struct("total_distance", "_key")).alias("m"))
    out = [F.col("m._key").alias(key), F.col("m.total_distance").alias("total_distance")]
    return pick.select(*out) if by is None else pick.select(F.col("_c").alias(by), *out)


def nearest_to_targets(df: DataFrame, value: str, targets: Sequence[float], key: str = "fire_id") -> DataFrame:
    """The row nearest to each target value (smallest key on ties); targets are a few numbers."""
    t = F.array(*[F.struct(F.lit(i).alias("target_order"), F.lit(float(x)).alias("target")) for i, x in enumerate(targets)])
    rows = df.where(F.col(value).isNotNull()).select(key, value, F.explode(t).alias("t"))
    d = F.round(F.abs(F.col(value) - F.col("t.target")), 9)
    return rows.groupBy("t.target_order").agg(F.min_by(key, F.struct(d, F.col(key))).alias(key))


def class_examples(df: DataFrame, label: str, vector: str, key: str = "fire_id") -> DataFrame:
    """Per class the row nearest to the class's median point; the medians of all coordinates come from one pass."""
    long = df.select(label, F.posexplode(vector).alias("_i", "_v"))
    mid = quantile_table(long, "_v", [0.5], [label, "_i"]).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q0"))), lambda s: s["q0"]).alias("_m"))
    sq = F.aggregate(F.zip_with(vector, "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return df.join(mid, label).groupBy(label).agg(F.min_by(key, F.struct(F.round(F.sqrt(sq), 9), F.col(key))).alias(key))


def story_event(df: DataFrame, condition: Column, score: str, key: str = "fire_id", ascending: bool = False) -> DataFrame:
    """First event by score among those meeting the condition; among all when none does."""
    ok = df.where(F.col(score).isNotNull()).withColumn("_hit", C.is_true(condition))
    some = ok.agg(F.coalesce(F.bool_or("_hit"), F.lit(False))).scalar()
    order = F.asc(score) if ascending else F.desc(score)
    return ok.where(F.col("_hit") | ~some).orderBy(order, key).limit(1).select(key, score)
