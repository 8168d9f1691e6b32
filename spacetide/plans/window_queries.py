"""Anomalies and rolling windows on cubes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking
from ..model import index_cube
from ..operators import verbs as V
from .inputs import CUBE, DENSE, events_cube, multi_cube, rounded
from .registry import query

KEYS = ("time", "y_idx", "x_idx")


def _out(df, *cols):
    return rounded(df.select(*KEYS, *(cols or ("value",))), *(cols or ("value",)))


@query(
    "anomaly_over_time",
    "5.01",
    f"WITH {CUBE} SELECT time, y_idx, x_idx, round(value - avg(value) OVER (PARTITION BY y_idx, x_idx), 6) AS value FROM cube",
)
def _(spark, d):
    return _out(V.anomaly(events_cube(spark, d)))


@query(
    "anomaly_over_space",
    "5.01",
    f"WITH {CUBE} SELECT time, y_idx, x_idx, round(value - avg(value) OVER (PARTITION BY time, x_idx), 6) AS value FROM cube",
)
def _(spark, d):
    return _out(V.anomaly(events_cube(spark, d), "y"))


@query(
    "zscore_cube",
    "5.02",
    f"""WITH {CUBE}, s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM cube WINDOW w AS (PARTITION BY y_idx, x_idx))
    SELECT time, y_idx, x_idx, round(CASE WHEN sd > 1e-4 THEN (value - m) / sd END, 6) AS value FROM s""",
)
def _(spark, d):
    return _out(V.zscore(events_cube(spark, d)))


@query(
    "anomaly_against_baseline_slice",
    "5.03",
    f"""WITH {CUBE} SELECT time, y_idx, x_idx, round(value - avg(value) FILTER (time BETWEEN DATE '2024-01-03' AND DATE '2024-01-12') OVER (PARTITION BY y_idx, x_idx), 8) AS value FROM cube""",
)
def _(spark, d):
    out = V.baseline_anomaly(events_cube(spark, d), "2024-01-03", "2024-01-12")
    return rounded(out.select(*KEYS, "value"), "value", digits=8)


@query(
    "difference_lag_two",
    "5.04",
    f"WITH {DENSE} SELECT time, y_idx, x_idx, round(value - lag(value, 2) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx), 6) AS value FROM grid",
)
def _(spark, d):
    return _out(V.temporal_difference(index_cube(events_cube(spark, d)), 2))


@query(
    "rolling_mean_trailing",
    "5.05",
    f"""WITH {DENSE} SELECT time, y_idx, x_idx, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS value FROM grid
    WINDOW w AS (PARTITION BY y_idx, x_idx ORDER BY t_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    return _out(V.rolling_mean(index_cube(events_cube(spark, d)), 5, 3))


@query(
    "rolling_mean_centred",
    "5.05",
    f"""WITH {DENSE} SELECT time, y_idx, x_idx, round(CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END, 6) AS value FROM grid
    WINDOW w AS (PARTITION BY y_idx, x_idx ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
)
def _(spark, d):
    return _out(V.rolling_mean(index_cube(events_cube(spark, d)), 4, center=True))


@query(
    "smoothed_mean",
    "5.06",
    f"""WITH {CUBE}, n AS (SELECT a.time, a.y_idx, a.x_idx, count(b.value) AS k, avg(b.value) AS v FROM cube a JOIN cube b
      ON a.time = b.time AND abs(a.y_idx - b.y_idx) <= 1 AND abs(a.x_idx - b.x_idx) <= 1 GROUP BY ALL)
    SELECT time, y_idx, x_idx, round(CASE WHEN k = 9 THEN v END, 6) AS value FROM n""",
)
def _(spark, d):
    return _out(V.smooth_mean(index_cube(events_cube(spark, d)), 3)).join(
        events_cube(spark, d).select(*KEYS), list(KEYS), "left_semi"
    )


@query(
    "rolling_tail_contrast",
    "5.07",
    f"""WITH {DENSE}, w AS (SELECT *, list(value) FILTER (value IS NOT NULL) OVER f AS vs FROM grid WINDOW f AS (PARTITION BY y_idx, x_idx ORDER BY t_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    q AS (SELECT *, round(list_aggregate(vs, 'quantile_cont', 0.8), 9) AS q FROM w),
    s AS (SELECT *, list_filter(vs, lambda v: round(v, 9) >= q) AS tail FROM q)
    SELECT time, y_idx, x_idx, round(CASE WHEN len(vs) >= 5 AND len(tail) > 0 THEN list_aggregate(tail, 'var_pop') - list_aggregate(vs, 'var_pop') END, 6) AS value FROM s""",
)
def _(spark, d):
    return _out(V.rolling_tail_contrast(index_cube(events_cube(spark, d)), 10, 0.8, 5))


_REF = "ref AS (SELECT k.time, k.value AS ref FROM cube k, (SELECT (max(y_idx) + 1) // 2 AS cy, (max(x_idx) + 1) // 2 AS cx FROM cube) c WHERE k.y_idx = c.cy AND k.x_idx = c.cx)"


@query(
    "rolling_correlation_with_centre",
    "5.08 3.09",
    f"""WITH {CUBE}, {_REF}, ax AS (SELECT DISTINCT time FROM cube),
    k AS (SELECT a.time, count(*) AS n FROM ax a JOIN ax b ON b.time BETWEEN a.time - 14 AND a.time GROUP BY 1 HAVING count(*) >= 5),
    j AS (SELECT c.time, c.y_idx, c.x_idx, CASE WHEN r.ref IS NOT NULL THEN c.value END AS x, CASE WHEN c.value IS NOT NULL THEN r.ref END AS y FROM cube c LEFT JOIN ref r ON r.time = c.time),
    w AS (SELECT *, count(x) OVER f AS nn, covar_pop(x, y) OVER f AS cv, sqrt(var_pop(x) OVER f * var_pop(y) OVER f) AS sp FROM j
      WINDOW f AS (PARTITION BY y_idx, x_idx ORDER BY time RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND CURRENT ROW))
    SELECT w.time, y_idx, x_idx, round(CASE WHEN nn >= 2 AND sp > 1e-12 THEN cv / sp END, 6) AS value FROM w JOIN k ON k.time = w.time""",
)
def _(spark, d):
    return _out(V.rolling_corr_vs_center(events_cube(spark, d), 14, 5))


@query(
    "rolling_user_statistic",
    "5.08 14.02",
    f"""WITH {CUBE}, {_REF}, ax AS (SELECT DISTINCT time FROM cube),
    k AS (SELECT a.time FROM ax a JOIN ax b ON b.time BETWEEN a.time - 10 AND a.time GROUP BY 1 HAVING count(*) >= 5),
    j AS (SELECT c.time, c.y_idx, c.x_idx, CASE WHEN r.ref IS NOT NULL THEN c.value END AS x, CASE WHEN c.value IS NOT NULL THEN r.ref END AS y FROM cube c LEFT JOIN ref r ON r.time = c.time),
    every AS (SELECT DISTINCT y_idx, x_idx FROM cube)
    SELECT k.time AS window_end, e.y_idx, e.x_idx, round(max(x) - min(y), 6) AS value FROM k CROSS JOIN every e
    LEFT JOIN j ON j.y_idx = e.y_idx AND j.x_idx = e.x_idx AND j.time BETWEEN k.time - 10 AND k.time GROUP BY ALL""",
)
def _(spark, d):
    def spread_ratio(x, y):
        return x.max() - y.min() if len(x) else float("nan")

    out = V.rolling_pairwise_stat(events_cube(spark, d), spread_ratio, 10, 5)
    return rounded(out, "value")


_SPLIT = """ends AS (SELECT time AS window_end FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t FROM (SELECT DISTINCT time FROM {src})) WHERE t % 5 = 0),
    ok AS (SELECT window_end FROM ends JOIN (SELECT DISTINCT time FROM {src}) a ON a.time BETWEEN window_end - 20 AND window_end GROUP BY 1 HAVING count(*) >= 4),
    p AS (SELECT o.window_end, c.y_idx, c.x_idx, c.value AS x, r.ref AS y FROM {src} c JOIN ok o ON c.time BETWEEN o.window_end - 20 AND o.window_end LEFT JOIN {ref} r ON r.time = c.time),
    v AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
    q AS (SELECT window_end, y_idx, x_idx, count(*) AS n, round(quantile_cont(x, 0.5), 9) AS qx, round(quantile_cont(y, 0.5), 9) AS qy FROM v GROUP BY ALL HAVING count(*) >= 4),
    s AS (SELECT v.*, CASE WHEN round(x, 9) <= qx AND round(y, 9) <= qy THEN 'low' WHEN round(x, 9) > qx AND round(y, 9) > qy THEN 'up' END AS side FROM v JOIN q USING (window_end, y_idx, x_idx)),
    k AS (SELECT window_end, y_idx, x_idx, side, rank() OVER (PARTITION BY window_end, y_idx, x_idx, side ORDER BY x) + (count(*) OVER (PARTITION BY window_end, y_idx, x_idx, side, x) - 1) / 2.0 AS u,
      rank() OVER (PARTITION BY window_end, y_idx, x_idx, side ORDER BY y) + (count(*) OVER (PARTITION BY window_end, y_idx, x_idx, side, y) - 1) / 2.0 AS w FROM s WHERE side IS NOT NULL),
    sc AS (SELECT window_end, y_idx, x_idx, side, CASE WHEN count(*) >= 4 AND sqrt(var_pop(u) * var_pop(w)) > 1e-12 THEN covar_pop(u, w) / sqrt(var_pop(u) * var_pop(w)) END AS r FROM k GROUP BY ALL),
    f AS (SELECT DISTINCT window_end, y_idx, x_idx FROM p)"""


@query(
    "rolling_split_synchrony",
    "5.09 5.11",
    f"""WITH {CUBE}, {_REF}, {_SPLIT.format(src='cube', ref='ref')}
    SELECT f.window_end, f.y_idx, f.x_idx, round(l.r, 6) AS bottom_synchrony, round(h.r, 6) AS top_synchrony, round(l.r - h.r, 6) AS bottom_minus_top
    FROM f LEFT JOIN sc l ON l.window_end = f.window_end AND l.y_idx = f.y_idx AND l.x_idx = f.x_idx AND l.side = 'low'
    LEFT JOIN sc h ON h.window_end = f.window_end AND h.y_idx = f.y_idx AND h.x_idx = f.x_idx AND h.side = 'up'""",
)
def _(spark, d):
    out = V.rolling_split_synchrony(events_cube(spark, d), 20, 4, 0.5, 5)
    return rounded(out, "bottom_synchrony", "top_synchrony", "bottom_minus_top")


@query("rolling_split_synchrony_two_variables", "5.09")
def _(spark, d):
    out = V.rolling_split_synchrony(multi_cube(spark, d), 28, 3, 0.5, 7, lower="view", upper="click")
    return rounded(out, "bottom_synchrony", "top_synchrony", "bottom_minus_top")


@query(
    "rolling_quantile_threshold",
    "5.10",
    f"""WITH {DENSE} SELECT time, y_idx, x_idx, round(quantile_cont(value, 0.8) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS threshold FROM grid""",
)
def _(spark, d):
    return _out(V.rolling_quantile(index_cube(events_cube(spark, d)), 7, 0.8), "threshold")


@query(
    "hopping_windows",
    "5.11",
    f"""WITH {DENSE}, e AS (SELECT time AS window_end FROM axis WHERE t_idx % 4 = 0)
    SELECT window_end, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value FROM e JOIN cube k ON k.time BETWEEN window_end - 7 AND window_end GROUP BY 1""",
)
def _(spark, d):
    c = events_cube(spark, d)
    w = V.time_windows(c, "7D", V.stride_periods(c, "4D"))
    out = c.join(w, "time").groupBy("window_end").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return rounded(out, "value")


@query(
    "rank_functions",
    "5.17",
    f"""WITH {CUBE} SELECT time, y_idx, x_idx, rank() OVER w + (count(*) OVER (PARTITION BY y_idx, x_idx, value) - 1) / 2.0 AS avg_rank,
      CAST(rank() OVER w AS INTEGER) AS min_rank,
      round((rank() OVER w + (count(*) OVER (PARTITION BY y_idx, x_idx, value) - 1) / 2.0) / count(*) OVER (PARTITION BY y_idx, x_idx), 6) AS pct_rank
    FROM cube WINDOW w AS (PARTITION BY y_idx, x_idx ORDER BY value)""",
)
def _(spark, d):
    c = events_cube(spark, d)
    return c.select(
        *KEYS,
        ranking.average_rank("value", ["y_idx", "x_idx"]).alias("avg_rank"),
        F.rank().over(W.partitionBy("y_idx", "x_idx").orderBy("value")).alias("min_rank"),
        F.round(ranking.percent_rank_average("value", ["y_idx", "x_idx"]), 6).alias("pct_rank"),
    )
