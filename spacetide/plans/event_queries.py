"""States, events, synchrony and tubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import index_cube
from ..operators import events as E
from ..operators import joins as J
from ..operators import states as S
from ..operators import synchrony as Y
from ..operators import tubes as T
from ..operators import verbs as V
from .inputs import CUBE, DENSE, MULTI, events_cube, multi_cube, rounded
from .registry import query

KEYS = ("time", "y_idx", "x_idx")
_STATE = ("state", "magnitude", "threshold")


def _dense(spark, d):
    return index_cube(events_cube(spark, d))


def _out(df):
    return rounded(df.select(*KEYS, *_STATE), "magnitude", "threshold", digits=8)


@query(
    "threshold_states",
    "9.01",
    f"WITH {DENSE} SELECT time, y_idx, x_idx, coalesce(value >= 20, false) AS state, round(value - 20, 8) AS magnitude, 20.0::DOUBLE AS threshold FROM grid",
)
def _(spark, d):
    return _out(S.threshold_state(_dense(spark, d), 20.0, "above"))


@query(
    "threshold_field_states",
    "9.01",
    f"""WITH {DENSE}, f AS (SELECT y_idx, x_idx, round(avg(value), 9) AS t FROM cube GROUP BY ALL)
    SELECT time, g.y_idx, g.x_idx, coalesce(value <= t, false) AS state, round(t - value, 8) AS magnitude, round(t, 8) AS threshold FROM grid g LEFT JOIN f ON f.y_idx = g.y_idx AND f.x_idx = g.x_idx""",
)
def _(spark, d):
    field = V.mean(events_cube(spark, d)).select("y_idx", "x_idx", F.round("value", 9).alias("threshold"))
    return _out(S.exceedance(_dense(spark, d), field, "below"))


@query(
    "quantile_states",
    "9.02",
    f"""WITH {DENSE}, q AS (SELECT *, round(quantile_cont(value, 0.8) OVER (PARTITION BY y_idx, x_idx), 9) AS t FROM grid)
    SELECT time, y_idx, x_idx, coalesce(value >= t, false) AS state, round(value - t, 8) AS magnitude, round(t, 8) AS threshold FROM q""",
)
def _(spark, d):
    return _out(S.quantile_state(_dense(spark, d), 0.8, "above"))


@query(
    "rolling_quantile_states",
    "9.02",
    f"""WITH {DENSE}, q AS (SELECT *, round(quantile_cont(value, 0.3) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS t FROM grid)
    SELECT time, y_idx, x_idx, coalesce(value <= t, false) AS state, round(t - value, 8) AS magnitude, round(t, 8) AS threshold FROM q""",
)
def _(spark, d):
    return _out(S.quantile_state(_dense(spark, d), 0.3, "below", rolling_window=10))


@query(
    "binary_states",
    "9.03",
    f"WITH {DENSE} SELECT time, y_idx, x_idx, coalesce(floor(value) % 3 <> 0, false) AS state, CASE WHEN coalesce(floor(value) % 3 <> 0, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS magnitude, 0.0::DOUBLE AS threshold FROM grid",
)
def _(spark, d):
    return _out(S.binary_state(_dense(spark, d), F.floor("value") % 3))


@query(
    "change_states",
    "9.04",
    f"""WITH {DENSE}, l AS (SELECT *, lag(value, 2) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx) AS b FROM grid), s AS (SELECT *, round((value - b) / nullif(b, 0), 9) AS r FROM l)
    SELECT time, y_idx, x_idx, coalesce(r >= 0.5, false) AS state, round(r - 0.5, 8) AS magnitude, 0.5::DOUBLE AS threshold FROM s""",
)
def _(spark, d):
    return _out(S.change_state(_dense(spark, d), "relative", 0.5, "2D"))


# --- events ------------------------------------------------------------------

_ZQ = f"""{DENSE}, z AS (SELECT *, CASE WHEN stddev_pop(value) OVER c > 1e-4 THEN round((value - avg(value) OVER c) / stddev_pop(value) OVER c, 9) END AS zv FROM grid WINDOW c AS (PARTITION BY y_idx, x_idx)),
st AS (SELECT *, round(quantile_cont(zv, {{q}}) OVER (PARTITION BY y_idx, x_idx), 9) AS t FROM z), sm AS (SELECT time, t_idx, y_idx, x_idx, coalesce(zv >= t, false) AS state, zv - t AS m FROM st)"""

_EVENTS = _ZQ.format(q=0.7) + """,
ac AS (SELECT *, lag(t_idx) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx) AS p FROM sm WHERE state),
rn AS (SELECT *, sum(CASE WHEN p IS NULL OR t_idx - p - 1 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY y_idx, x_idx ORDER BY t_idx) AS run FROM ac),
sp AS (SELECT y_idx, x_idx, run, min(t_idx) AS a, max(t_idx) AS b, min(time) AS s, max(time) AS e, count(*) AS n FROM rn GROUP BY ALL HAVING count(*) >= 2),
ev AS (SELECT sp.y_idx, sp.x_idx, s AS start, e AS "end", a, b, CAST(n AS BIGINT) AS duration, max(m) AS peak, avg(m) AS mean, sum(m) AS integral FROM sp JOIN sm ON sm.y_idx = sp.y_idx AND sm.x_idx = sp.x_idx AND sm.t_idx BETWEEN a AND b GROUP BY ALL),
cat AS (SELECT *, row_number() OVER (ORDER BY y_idx, x_idx, start) AS event_id, CAST(row_number() OVER c - 1 AS INTEGER) AS sequence_index,
  CAST(date_diff('day', lag("end") OVER c, start) AS DOUBLE) AS time_since_previous_event FROM ev WINDOW c AS (PARTITION BY y_idx, x_idx ORDER BY start))"""


def _states(spark, d, q=0.7):
    z = V.zscore(_dense(spark, d), digits=9)
    return S.quantile_state(z, q, "above")


@query(
    "detected_events_catalog",
    "9.05",
    f"""WITH {_EVENTS} SELECT event_id, y_idx, x_idx, start, "end", duration, round(peak, 6) AS peak, round(mean, 6) AS mean, round(integral, 6) AS integral, sequence_index, time_since_previous_event FROM cat""",
)
def _(spark, d):
    cat = E.detect_events(_states(spark, d), min_duration=2, max_gap=1)
    return rounded(cat, "peak", "mean", "integral")


@query(
    "labelled_event_cube",
    "9.05",
    f"""WITH {_EVENTS} SELECT sm.time, sm.y_idx, sm.x_idx, (state AND event_id IS NOT NULL) AS event_active, coalesce(event_id, -1) AS event_id, CAST(t_idx - a AS INTEGER) AS event_age,
      start AS event_start, duration AS event_duration, coalesce(sequence_index, -1) AS sequence_index FROM sm LEFT JOIN cat ON cat.y_idx = sm.y_idx AND cat.x_idx = sm.x_idx AND sm.t_idx BETWEEN a AND b""",
)
def _(spark, d):
    cube = E.label_events(_states(spark, d), min_duration=2, max_gap=1)
    return cube.select("time", "y_idx", "x_idx", "event_active", "event_id", "event_age", "event_start", "event_duration", "sequence_index")


# --- synchrony ---------------------------------------------------------------

_PAIRS = """nn AS (SELECT max(x_idx) + 1 AS nx FROM cube), pl AS (SELECT DISTINCT y_idx * nx + x_idx AS space, CAST(y_idx AS DOUBLE) AS y, CAST(x_idx AS DOUBLE) AS x FROM cube, nn),
km AS (SELECT a.space AS source, b.space AS target, CASE WHEN abs(a.y) <= 90 AND abs(b.y) <= 90 THEN
  2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) ELSE sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) END AS distance FROM pl a JOIN pl b ON a.space < b.space),
pr AS (SELECT * FROM km WHERE distance <= 170)"""


def _pairs(states):
    return J.spatial_pairs(J.places_of(states), "neighbors", radius=170)


_OCC = f"""{_ZQ.format(q=0.6)}, {_PAIRS}, sa AS (SELECT y_idx * nx + x_idx AS space, time, m FROM sm, nn WHERE state)"""


def _occ(score):
    return f"""WITH {_OCC}, wd AS (SELECT a.time AS window_end, b.time FROM axis a JOIN axis b ON b.time BETWEEN a.time - 14 AND a.time WHERE a.t_idx % 7 = 0),
    sz AS (SELECT window_end, CAST(count(*) AS DOUBLE) AS n FROM wd GROUP BY 1),
    pn AS (SELECT window_end, space, CAST(count(*) AS DOUBLE) AS c FROM sa JOIN wd USING (time) GROUP BY ALL),
    jn AS (SELECT window_end, source, target, CAST(count(*) AS DOUBLE) AS b FROM pr JOIN sa x ON x.space = source JOIN sa y ON y.space = target AND y.time = x.time JOIN wd ON wd.time = x.time GROUP BY ALL),
    al AS (SELECT sz.window_end, pr.source, pr.target, pr.distance, sz.n, coalesce(b, 0) AS b, coalesce(l.c, 0) AS l, coalesce(r.c, 0) AS r FROM pr CROSS JOIN sz LEFT JOIN jn ON jn.window_end = sz.window_end AND jn.source = pr.source AND jn.target = pr.target
      LEFT JOIN pn l ON l.window_end = sz.window_end AND l.space = pr.source LEFT JOIN pn r ON r.window_end = sz.window_end AND r.space = pr.target)
    SELECT window_end, source, target, round(distance, 5) AS distance, round({score}, 6) AS occurrence_synchrony, b AS joint_event_count, l + r - b AS event_union_count, n AS valid_sample_count FROM al"""


@query("occurrence_jaccard_windows", "9.06", _occ("b / nullif(l + r - b, 0)"))
def _(spark, d):
    st = _states(spark, d, 0.6)
    out = Y.occurrence_edges(st, _pairs(st), method="jaccard", window="14D", stride=7)
    return rounded(rounded(out, "occurrence_synchrony"), "distance", digits=5)


@query("occurrence_phi_windows", "9.06", _occ("(b * (n - l - r + b) - (l - b) * (r - b)) / nullif(sqrt(l * (n - l) * r * (n - r)), 0)"))
def _(spark, d):
    st = _states(spark, d, 0.6)
    out = Y.occurrence_edges(st, _pairs(st), method="phi", window="14D", stride=7)
    return rounded(rounded(out, "occurrence_synchrony"), "distance", digits=5)


_JAC = """jc AS (SELECT CAST(count(*) AS DOUBLE) AS b, source, target FROM pr JOIN sa x ON x.space = source JOIN sa y ON y.space = target AND y.time = x.time GROUP BY ALL), pc AS (SELECT space, CAST(count(*) AS DOUBLE) AS c FROM sa GROUP BY 1),
ed AS (SELECT pr.source, pr.target, distance, coalesce(b, 0) / nullif(coalesce(l.c, 0) + coalesce(r.c, 0) - coalesce(b, 0), 0) AS v FROM pr LEFT JOIN jc ON jc.source = pr.source AND jc.target = pr.target LEFT JOIN pc l ON l.space = pr.source LEFT JOIN pc r ON r.space = pr.target)"""


@query(
    "occurrence_map",
    "4.10 9.06",
    f"""WITH {_OCC}, {_JAC} SELECT (SELECT max(time) FROM axis) AS window_end, space, round(avg(v), 6) AS occurrence_synchrony FROM (SELECT source AS space, v FROM ed UNION ALL SELECT target, v FROM ed) GROUP BY space""",
)
def _(spark, d):
    st = _states(spark, d, 0.6)
    return rounded(Y.edge_to_map(Y.occurrence_edges(st, _pairs(st)), ["occurrence_synchrony"]), "occurrence_synchrony")


@query(
    "occurrence_regional_summary",
    "4.11 9.06",
    f"""WITH {_OCC}, {_JAC} SELECT (SELECT max(time) FROM axis) AS window_end, round(avg(v), 6) AS mean_occurrence_synchrony, round(quantile_cont(v, 0.5), 6) AS median_occurrence_synchrony, CAST(count(*) AS BIGINT) AS pair_count, round(avg(distance), 5) AS mean_pair_distance FROM ed""",
)
def _(spark, d):
    st = _states(spark, d, 0.6)
    out = Y.regional_summary(Y.occurrence_edges(st, _pairs(st)), "occurrence_synchrony")
    return rounded(rounded(out, "mean_occurrence_synchrony", "median_occurrence_synchrony"), "mean_pair_distance", digits=5)


@query(
    "occurrence_reference_map",
    "9.06",
    f"""WITH {_OCC}, ce AS (SELECT ((max(y_idx) + 1) // 2) * max(nx) + (max(x_idx) + 1) // 2 AS r FROM cube, nn), pc AS (SELECT space, CAST(count(*) AS DOUBLE) AS c FROM sa GROUP BY 1),
    jc AS (SELECT x.space, CAST(count(*) AS DOUBLE) AS b FROM sa x JOIN sa y ON y.time = x.time JOIN ce ON y.space = r GROUP BY 1)
    SELECT (SELECT max(time) FROM axis) AS window_end, pl.space, round(coalesce(b, 0) / (SELECT count(*) FROM axis), 6) AS occurrence_synchrony FROM pl LEFT JOIN jc ON jc.space = pl.space""",
)
def _(spark, d):
    st = _states(spark, d, 0.6)
    pairs = J.spatial_pairs(J.places_of(st), "reference")
    return rounded(Y.reference_map(Y.occurrence_edges(st, pairs, method="joint_probability"), ["occurrence_synchrony"]), "occurrence_synchrony")


@query(
    "severity_synchrony",
    "9.07",
    f"""WITH {_OCC}, jn AS (SELECT source, target, round(x.m, 9) AS u0, round(y.m, 9) AS v0, x.m AS xm, y.m AS ym FROM pr JOIN sa x ON x.space = source JOIN sa y ON y.space = target AND y.time = x.time),
    rk AS (SELECT *, rank() OVER (PARTITION BY source, target ORDER BY u0) + (count(*) OVER (PARTITION BY source, target, u0) - 1) / 2.0 AS u, rank() OVER (PARTITION BY source, target ORDER BY v0) + (count(*) OVER (PARTITION BY source, target, v0) - 1) / 2.0 AS v FROM jn),
    sc AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS n, covar_pop(u, v) / nullif(sqrt(var_pop(u) * var_pop(v)), 0) AS s, avg(xm) AS a, avg(ym) AS b, avg(abs(xm - ym)) AS c FROM rk GROUP BY ALL)
    SELECT pr.source, pr.target, coalesce(n, 0) AS joint_observation_count, round(CASE WHEN n >= 4 THEN s END, 6) AS severity_synchrony, round(CASE WHEN n >= 4 THEN a END, 6) AS source_mean_magnitude,
      round(CASE WHEN n >= 4 THEN b END, 6) AS target_mean_magnitude, round(CASE WHEN n >= 4 THEN c END, 6) AS mean_absolute_magnitude_difference FROM pr LEFT JOIN sc ON sc.source = pr.source AND sc.target = pr.target""",
)
def _(spark, d):
    st = _states(spark, d, 0.6)
    out = Y.severity_edges(st, _pairs(st), min_joint_events=4).drop("window_end", "distance")
    return rounded(out, "severity_synchrony", "source_mean_magnitude", "target_mean_magnitude", "mean_absolute_magnitude_difference")


#: Candidates within four days in the order in which a greedy match takes them; a fold keeps those whose two events are both free.
_MATCH = f"""{_EVENTS}, {_PAIRS}, cs AS (SELECT y_idx * nx + x_idx AS space, event_id, start, duration FROM cat, nn), cnt AS (SELECT space, count(*) AS n FROM cs GROUP BY 1),
cand AS (SELECT source, target, s.event_id AS s, t.event_id AS t, CAST(date_diff('day', s.start, t.start) AS DOUBLE) AS lag, CAST(s.duration AS DOUBLE) AS sd, CAST(t.duration AS DOUBLE) AS td FROM pr JOIN cs s ON s.space = source JOIN cs t ON t.space = target AND abs(date_diff('day', s.start, t.start)) <= 4),
gl AS (SELECT source, target, list([{{'s': s, 't': t, 'lag': lag, 'sd': sd, 'td': td}}] ORDER BY abs(lag), s, t) AS l FROM cand GROUP BY ALL),
kept AS (SELECT source, target, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda e: e.s = x[1].s OR e.t = x[1].t)) > 0 THEN a ELSE list_concat(a, x) END)) AS m FROM gl),
mt AS (SELECT source, target, m.s AS s, m.t AS t, m.lag AS lag, abs(m.lag) AS al, m.sd AS sd, m.td AS td FROM kept)"""
_LAGS = "CAST(count(*) AS BIGINT) AS n, avg(lag) AS ml, quantile_cont(al, 0.5) AS md"
_SIDES = "FROM pr LEFT JOIN sc ON sc.source = pr.source AND sc.target = pr.target LEFT JOIN cnt a ON a.space = pr.source LEFT JOIN cnt b ON b.space = pr.target"
_SHARED = """pr.source, pr.target, round(distance, 5) AS distance, coalesce(n, 0) AS matched_event_count, round(ml, 6) AS mean_lag, md AS median_absolute_lag,
  CAST(greatest(coalesce(a.n, 0) - coalesce(sc.n, 0), 0) AS BIGINT) AS source_unmatched_event_count, CAST(greatest(coalesce(b.n, 0) - coalesce(sc.n, 0), 0) AS BIGINT) AS target_unmatched_event_count""".replace("coalesce(n, 0)", "coalesce(sc.n, 0)")


@query("matched_events", "3.10", f"WITH {_MATCH} SELECT source, target, s AS source_event_id, t AS target_event_id, lag AS lag_days FROM mt")
def _(spark, d):
    st = _states(spark, d)
    cat = E.detect_events(st, min_duration=2, max_gap=1)
    cat = E.with_space(cat, V.grid_width(st))
    return E.match_events(_pairs(st), cat, tolerance="4D").select("source", "target", "source_event_id", "target_event_id", "lag_days")


def _catalog(spark, d):
    st = _states(spark, d)
    return st, E.with_space(E.detect_events(st, min_duration=2, max_gap=1), V.grid_width(st))


@query("timing_synchrony_edges", "9.08", f"WITH {_MATCH}, sc AS (SELECT source, target, {_LAGS}, avg(exp(-al / 3)) AS v FROM mt GROUP BY ALL) SELECT {_SHARED}, round(v, 6) AS timing_synchrony {_SIDES}")
def _(spark, d):
    st, cat = _catalog(spark, d)
    out = rounded(Y.timing_synchrony(cat, _pairs(st), tolerance="4D"), "timing_synchrony", "mean_lag")
    return rounded(out, "distance", digits=5)


@query(
    "timing_synchrony_map",
    "9.08 4.10",
    f"""WITH {_MATCH}, sc AS (SELECT source, target, count(*) AS n, avg(1 / (1 + al)) AS v FROM mt GROUP BY ALL), ed AS (SELECT pr.source, pr.target, v, coalesce(n, 0) AS n FROM pr LEFT JOIN sc ON sc.source = pr.source AND sc.target = pr.target)
    SELECT space, round(avg(v), 6) AS timing_synchrony, round(avg(n), 6) AS matched_event_count FROM (SELECT source AS space, v, n FROM ed UNION ALL SELECT target, v, n FROM ed) GROUP BY 1""",
)
def _(spark, d):
    st, cat = _catalog(spark, d)
    edges = Y.timing_synchrony(cat, _pairs(st), tolerance="4D", score="inverse")
    return rounded(Y.edge_to_map(edges, ["timing_synchrony", "matched_event_count"]), "timing_synchrony", "matched_event_count")


@query(
    "duration_synchrony_edges",
    "9.09",
    f"""WITH {_MATCH}, rk AS (SELECT *, rank() OVER (PARTITION BY source, target ORDER BY sd) + (count(*) OVER (PARTITION BY source, target, sd) - 1) / 2.0 AS u, rank() OVER (PARTITION BY source, target ORDER BY td) + (count(*) OVER (PARTITION BY source, target, td) - 1) / 2.0 AS w FROM mt),
    sc AS (SELECT source, target, {_LAGS}, CASE WHEN count(*) >= 3 AND sqrt(var_pop(u) * var_pop(w)) > 1e-12 THEN covar_pop(u, w) / sqrt(var_pop(u) * var_pop(w)) END AS v, avg(1 - abs(sd - td) / greatest(sd, td, 1)) AS sim, avg(sd - td) AS diff FROM rk GROUP BY ALL)
    SELECT {_SHARED}, round(v, 6) AS duration_synchrony, round(sim, 6) AS duration_similarity, round(diff, 6) AS mean_duration_difference {_SIDES}""",
)
def _(spark, d):
    st, cat = _catalog(spark, d)
    out = Y.duration_synchrony(cat, _pairs(st), tolerance="4D", min_matched_events=3)
    return rounded(rounded(out, "duration_synchrony", "duration_similarity", "mean_duration_difference", "mean_lag"), "distance", digits=5)


@query(
    "coupled_states_by_lag",
    "9.10",
    f"""WITH {MULTI}, cube AS (SELECT time, y_idx, x_idx, value FROM multi WHERE variable IN ('click', 'view')),
    axis AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM cube)), cl AS (SELECT DISTINCT y_idx, x_idx FROM cube),
    s AS (SELECT variable, y_idx, x_idx, t_idx FROM multi JOIN axis USING (time) WHERE value >= 10), lg AS (SELECT * FROM (VALUES (0, '0D', 0), (1, '2D', 2), (2, '-3', -3)) v(ord, lag, p)), nt AS (SELECT count(*) AS n FROM axis),
    a AS (SELECT ord, y_idx, x_idx, count(*) AS c FROM s, lg, nt WHERE variable = 'click' AND t_idx + p BETWEEN 0 AND n - 1 GROUP BY ALL),
    b AS (SELECT ord, y_idx, x_idx, count(*) AS c FROM s, lg, nt WHERE variable = 'view' AND t_idx - p BETWEEN 0 AND n - 1 GROUP BY ALL),
    j AS (SELECT ord, x.y_idx, x.x_idx, count(*) AS c FROM s x CROSS JOIN lg JOIN s y ON y.y_idx = x.y_idx AND y.x_idx = x.x_idx AND y.t_idx = x.t_idx + p WHERE x.variable = 'click' AND y.variable = 'view' GROUP BY ALL),
    e AS (SELECT cl.y_idx, cl.x_idx, lg.ord, lg.lag, coalesce(j.c, 0) AS jc, coalesce(j.c, 0) / nullif(coalesce(a.c, 0) + coalesce(b.c, 0) - coalesce(j.c, 0), 0) AS score, n - abs(p) AS v FROM cl CROSS JOIN lg CROSS JOIN nt
      LEFT JOIN a ON a.ord = lg.ord AND a.y_idx = cl.y_idx AND a.x_idx = cl.x_idx LEFT JOIN b ON b.ord = lg.ord AND b.y_idx = cl.y_idx AND b.x_idx = cl.x_idx LEFT JOIN j ON j.ord = lg.ord AND j.y_idx = cl.y_idx AND j.x_idx = cl.x_idx)
    SELECT y_idx, x_idx, lag, round(score, 6) AS coupling_score, CAST(jc AS BIGINT) AS joint_event_count, CAST(v AS BIGINT) AS valid_sample_count,
      first_value(CASE WHEN score IS NOT NULL THEN lag END) OVER (PARTITION BY y_idx, x_idx ORDER BY score DESC NULLS LAST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_lag FROM e""",
)
def _(spark, d):
    m = multi_cube(spark, d).where("variable in ('click', 'view')")
    frame = index_cube(m.dropDuplicates(["time", "y_idx", "x_idx"])).drop("value")

    def side(v):
        own = m.where(F.col("variable") == v).select("time", "y_idx", "x_idx", "value")
        return S.threshold_state(frame.join(own, ["time", "y_idx", "x_idx"], "left"), 10.0)

    out = Y.sync_with(side("click"), side("view"), ["0D", "2D", -3])
    return rounded(out, "coupling_score")


_TAIL = """p AS (SELECT y_idx, a.value AS x, b.value AS y FROM multi a JOIN multi b USING (time, y_idx, x_idx) WHERE a.variable = 'click' AND b.variable = 'view'),
    r AS (SELECT y_idx, x, y, (rank() OVER (PARTITION BY y_idx ORDER BY x) + (count(*) OVER (PARTITION BY y_idx, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY y_idx) + 1) AS u,
      (rank() OVER (PARTITION BY y_idx ORDER BY y) + (count(*) OVER (PARTITION BY y_idx, y) - 1) / 2.0) / (count(*) OVER (PARTITION BY y_idx) + 1) AS v FROM p)"""


@query(
    "tail_association_by_row",
    "9.11",
    f"""WITH {MULTI}, {_TAIL}, c AS (SELECT *, u - avg(u) OVER (PARTITION BY y_idx) AS cu, v - avg(v) OVER (PARTITION BY y_idx) AS cv, round(u + v, 12) AS uv FROM r),
    g AS (SELECT y_idx, count(*) AS n, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS pe, covar_pop(u, v) / nullif(sqrt(var_pop(u) * var_pop(v)), 0) AS sp, count(*) * sqrt(var_pop(u) * var_pop(v)) AS s,
      sum(cu * cv) FILTER (uv > 0 AND uv < round(2.0::DOUBLE / 3, 12)) AS lo, count(*) FILTER (uv > 0 AND uv < round(2.0::DOUBLE / 3, 12)) AS nl, sum(cu * cv) FILTER (uv > round(4.0::DOUBLE / 3, 12) AND uv < 2) AS hi, count(*) FILTER (uv > round(4.0::DOUBLE / 3, 12) AND uv < 2) AS nh FROM c GROUP BY 1),
    f AS (SELECT *, CASE WHEN nl >= 2 THEN lo / nullif(s, 0) END AS l, CASE WHEN nh >= 2 THEN hi / nullif(s, 0) END AS h FROM g), k AS (SELECT *, round(l - h, 9) AS df FROM f)
    SELECT y_idx, CAST(n AS BIGINT) AS n, round(pe, 6) AS pearson, round(sp, 6) AS spearman, round(l, 6) AS lower_partial_spearman, round(h, 6) AS upper_partial_spearman, CAST(nl AS BIGINT) AS lower_count, CAST(nh AS BIGINT) AS upper_count, round(df, 6) AS difference,
      CASE WHEN df IS NULL THEN 'undetermined' WHEN abs(df) <= 0.02 THEN 'approximately symmetric' WHEN df > 0 THEN 'left-tail dominant' ELSE 'right-tail dominant' END AS dominance FROM k""",
)
def _(spark, d):
    m = multi_cube(spark, d)
    a = m.where("variable = 'click'").select("time", "y_idx", "x_idx", F.col("value").alias("a"))
    b = m.where("variable = 'view'").select("time", "y_idx", "x_idx", F.col("value").alias("b"))
    both = a.join(b, ["time", "y_idx", "x_idx"])
    out = Y.tail_association(both, "a", "b", ["y_idx"])
    return rounded(out, "pearson", "spearman", "lower_partial_spearman", "upper_partial_spearman", "difference")


@query(
    "paired_preprocessing",
    "8.05",
    f"""WITH {MULTI}, {_TAIL} SELECT y_idx, CAST(count(*) AS BIGINT) AS n, round(max(u), 6) AS max_rank, round(max((x - m) / s), 6) AS max_z, round(max(x - m), 6) AS max_anomaly
    FROM (SELECT *, avg(x) OVER (PARTITION BY y_idx) AS m, stddev_samp(x) OVER (PARTITION BY y_idx) AS s FROM r) GROUP BY 1""",
)
def _(spark, d):
    m = multi_cube(spark, d)
    a = m.where("variable = 'click'").select("time", "y_idx", "x_idx", F.col("value").alias("a"))
    b = m.where("variable = 'view'").select("time", "y_idx", "x_idx", F.col("value").alias("b"))
    both = a.join(b, ["time", "y_idx", "x_idx"])
    top = lambda mode, name: Y.paired_series(both, "a", "b", ["y_idx"], mode).groupBy("y_idx").agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.max("x").alias(name)
    )
    out = top("rank_only", "max_rank").join(top("zscore", "max_z"), "y_idx").join(top("anomaly", "max_anomaly"), "y_idx")
    return rounded(out.select("y_idx", F.col("n_max_z").alias("n"), "max_rank", "max_z", "max_anomaly"), "max_rank", "max_z", "max_anomaly")


# --- tubes -------------------------------------------------------------------


def _mask(spark, d):
    """Suitable cells of the dense cube (a user rule that returns a boolean column)."""
    rule = V.suitability("value", 8, 60)
    return _dense(spark, d).withColumn("mask", rule)


@query("labelled_tubes_metrics", "9.12 9.13 14.03")
def _(spark, d):
    return T.tube_metrics(T.label_tubes(_mask(spark, d), 6))


@query("labelled_tubes_full_neighborhood", "9.12")
def _(spark, d):
    return T.tube_metrics(T.label_tubes(_mask(spark, d).where("value is null or value > 0"), 26))


@query(
    "component_metrics",
    "9.13",
    f"""WITH {DENSE}, v AS (SELECT *, y_idx + 1 AS tube_id FROM grid WHERE value BETWEEN 8 AND 60), s AS (SELECT tube_id, time, count(*) AS n FROM v GROUP BY ALL)
    SELECT v.tube_id, CAST(count(DISTINCT v.time) AS BIGINT) AS duration_steps, CAST(count(*) AS BIGINT) AS n_voxels, min(v.time) AS time_start, max(v.time) AS time_end, CAST(min(y_idx) AS DOUBLE) AS y_min, CAST(max(y_idx) AS DOUBLE) AS y_max,
      CAST(min(x_idx) AS DOUBLE) AS x_min, CAST(max(x_idx) AS DOUBLE) AS x_max, round((SELECT avg(n) FROM s WHERE s.tube_id = v.tube_id), 6) AS cells_per_timestep_mean, (SELECT max(n) FROM s WHERE s.tube_id = v.tube_id) AS cells_per_timestep_max FROM v GROUP BY v.tube_id""",
)
def _(spark, d):
    voxels = _mask(spark, d).where("mask").withColumn("tube_id", F.col("y_idx") + 1)
    return rounded(T.tube_metrics(voxels), "cells_per_timestep_mean")


@query(
    "longest_component",
    "6.02",
    f"""WITH {DENSE}, v AS (SELECT *, y_idx + 1 AS tube_id FROM grid WHERE value BETWEEN 8 AND 60)
    SELECT tube_id, CAST(count(DISTINCT time) AS BIGINT) AS duration_steps, CAST(count(*) AS BIGINT) AS n_voxels FROM v GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
)
def _(spark, d):
    voxels = _mask(spark, d).where("mask").withColumn("tube_id", F.col("y_idx") + 1)
    return T.select_tube(T.tube_metrics(voxels), "longest").select("tube_id", "duration_steps", "n_voxels")


@query(
    "masked_point_values",
    "9.14",
    f"WITH {CUBE} SELECT time, CAST(y_idx AS DOUBLE) AS y, CAST(x_idx AS DOUBLE) AS x, value FROM cube WHERE value BETWEEN 8 AND 60",
)
def _(spark, d):
    return T.masked_points(events_cube(spark, d), _mask(spark, d))


@query("tube_cross_sections", "10.16")
def _(spark, d):
    rings = T.tube_sections(T.label_tubes(_mask(spark, d), 6))
    return rings.select("tube_id", "time", F.size("ring").alias("n_vertices"))


