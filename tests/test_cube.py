"""Cube model, verbs, states and events against hand-derived answers."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spacetide.model import index_cube, null_missing
from spacetide.operators import events as E
from spacetide.operators import states as S
from spacetide.operators import synchrony as Y
from spacetide.operators import tubes as T
from spacetide.operators import verbs as V

D0 = dt.date(2001, 1, 1)


def cube(spark, data):
    """data: list of (t, y, x, value)."""
    out = [(D0 + dt.timedelta(days=t), y, x, float(y), float(x), v) for t, y, x, v in data]
    return spark.createDataFrame(out, "time date, y_idx bigint, x_idx bigint, y double, x double, value double")


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "value double")
    assert null_missing(df, "value").where("value is null").count() == 2


def test_index_cube_adds_missing_cells(spark):
    c = cube(spark, [(0, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 3.0)])
    dense = index_cube(c)
    assert dense.count() == 6
    assert dense.where("value is null").count() == 3


def test_windows_count_grid_positions_on_sparse_cubes(spark):
    sparse = index_cube(cube(spark, [(0, 0, 0, 1.0), (2, 0, 0, 5.0), (1, 0, 1, 9.0)]), dense=False)
    got = rows(V.temporal_difference(sparse, 1).where("x_idx = 0"), "t_idx", "value")
    assert got == [(0, None), (2, None)]  # the step before 2 is missing, not step 0
    assert rows(V.temporal_difference(sparse, 2).where("x_idx = 0"), "t_idx", "value")[1] == (2, 4.0)


def test_zscore_is_null_for_constant_series(spark):
    z = V.zscore(cube(spark, [(t, 0, 0, 4.0) for t in range(3)]))
    assert z.where("value is not null").count() == 0


def test_coarsen_trims_partial_blocks(spark):
    c = cube(spark, [(0, y, x, float(x)) for y in range(3) for x in range(5)])
    assert rows(V.coarsen_mean(c, 2, 2), "y_idx", "x_idx", "value") == [(0, 0, 0.5), (0, 1, 2.5)]
    with pytest.raises(ValueError):
        V.coarsen_mean(c, 0, 1)


def test_guards(spark):
    c = cube(spark, [(0, 0, 0, None)])
    with pytest.raises(ValueError):
        V.crop_to_finite(c)
    with pytest.raises(ValueError):
        V.month_filter(c, [1], time="value")
    with pytest.raises(ValueError):
        V.mean(c, "band")
    with pytest.raises(TypeError):
        V.pipe(c) | 3
    two = c.withColumn("variable", F.lit("a")).unionByName(c.withColumn("variable", F.lit("b")))
    with pytest.raises(ValueError):
        V.select_variable(two)


def test_pipe_chain(spark):
    c = cube(spark, [(t, 0, 0, float(t)) for t in range(4)])
    out = (V.pipe(c) | V.anomaly | V.variance).unwrap()
    assert out.first()["value"] == pytest.approx(np.var(range(4)))


def test_change_state_relative_zero_denominator(spark):
    c = index_cube(cube(spark, [(0, 0, 0, 0.0), (1, 0, 0, 5.0), (2, 0, 0, 10.0)]))
    got = rows(S.change_state(c, "relative", 0.5, 1), "t_idx", "state", "magnitude")
    assert got == [(0, False, None), (1, False, None), (2, True, 0.5)]


def test_binary_state_null_is_inactive(spark):
    got = rows(S.binary_state(cube(spark, [(0, 0, 0, None), (1, 0, 0, 2.0)])), "state", "magnitude")
    assert got == [(False, 0.0), (True, 1.0)]


RUN = "TFTTFFT"


@pytest.mark.parametrize(
    "gap,least,expected",
    [
        (0, 1, [(0, 0, 1), (2, 3, 2), (6, 6, 1)]),
        (0, 2, [(2, 3, 2)]),
        (1, 1, [(0, 3, 3), (6, 6, 1)]),
        (1, 2, [(0, 3, 3)]),
        (2, 2, [(0, 6, 4)]),
    ],
)
def test_runs_bridge_gaps(spark, gap, least, expected):
    c = index_cube(cube(spark, [(t, 0, 0, float(t)) for t in range(7)]))
    st = c.withColumns({"state": F.col("t_idx").isin([i for i, f in enumerate(RUN) if f == "T"]), "magnitude": F.col("value")})
    cat = E.detect_events(st, min_duration=least, max_gap=gap)
    got = [((s - D0).days, (e - D0).days, n) for s, e, n in rows(cat, "start", "end", "duration")]
    assert got == expected
    assert [r[0] for r in rows(cat, "event_id")] == list(range(1, len(expected) + 1))
    if (gap, least) == (2, 2):
        row = cat.first()  # magnitudes of bridged gaps count
        assert (row["integral"], row["peak"]) == (21.0, 6.0)
        inside = E.label_events(st, min_duration=2, max_gap=2)
        assert inside.where("event_id = 1").count() == 7 and inside.where("event_active").count() == 4


def _greedy(cand):
    used_s, used_t, out = set(), set(), []
    for lag, s, t in sorted(cand):
        if s not in used_s and t not in used_t:
            out.append((s, t))
            used_s.add(s)
            used_t.add(t)
    return sorted(out)


def test_greedy_matching_equals_brute_force(spark):
    rng = random.Random(3)
    events = [(i + 1, i % 2, D0 + dt.timedelta(days=rng.randrange(40)), rng.randrange(1, 5)) for i in range(30)]
    cat = spark.createDataFrame([(i, sp, s, s + dt.timedelta(days=n - 1), n) for i, sp, s, n in events], "event_id bigint, space bigint, start date, end date, duration bigint")
    pairs = spark.createDataFrame([(0, 1, 1.0)], "source bigint, target bigint, distance double")
    got = rows(E.match_events(pairs, cat, tolerance="5D"), "source_event_id", "target_event_id")
    a, b = [e for e in events if e[1] == 0], [e for e in events if e[1] == 1]
    cand = [(abs((y[2] - x[2]).days), x[0], y[0]) for x in a for y in b if abs((y[2] - x[2]).days) <= 5]
    assert got == _greedy(cand)
    dur = Y.duration_synchrony(cat, pairs, tolerance="5D", min_matched_events=1000).first()
    assert dur["duration_synchrony"] is None and dur["duration_similarity"] is not None
    tim = Y.timing_synchrony(cat, pairs, tolerance="5D").first()
    assert tim["matched_event_count"] + tim["source_unmatched_event_count"] == len(a)


def test_pairs_without_matches_are_kept(spark):
    cat = spark.createDataFrame([(1, 0, D0, D0, 1)], "event_id bigint, space bigint, start date, end date, duration bigint")
    pairs = spark.createDataFrame([(0, 1, 1.0)], "source bigint, target bigint, distance double")
    row = Y.timing_synchrony(cat, pairs).first()
    assert row["timing_synchrony"] is None and row["source_unmatched_event_count"] == 1


def test_occurrence_with_an_inactive_side(spark):
    c = index_cube(cube(spark, [(t, 0, x, 1.0) for t in range(4) for x in range(2)]))
    st = c.withColumns({"state": (F.col("x_idx") == 0) & (F.col("t_idx") < 2), "magnitude": F.lit(1.0)})
    pairs = spark.createDataFrame([(0, 1, 1.0)], "source bigint, target bigint, distance double")
    assert Y.occurrence_edges(st, pairs).first()["occurrence_synchrony"] == 0.0
    assert Y.occurrence_edges(st, pairs, method="phi").first()["occurrence_synchrony"] is None
    none = st.withColumn("state", F.lit(False))
    assert Y.occurrence_edges(none, pairs).first()["occurrence_synchrony"] is None


def _components(voxels, connectivity):
    left, parts = set(voxels), []
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s) and (connectivity == 26 or sum(map(abs, s)) == 1)]
    while left:
        todo, part = [left.pop()], set()
        while todo:
            v = todo.pop()
            part.add(v)
            for s in steps:
                n = tuple(a + b for a, b in zip(v, s))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(frozenset(part))
    return set(parts)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_tubes_equal_flood_fill(spark, connectivity):
    rng = random.Random(connectivity)
    shape = (5, 4, 6)
    on = {v for v in itertools.product(*map(range, shape)) if rng.random() < (0.35 if connectivity == 6 else 0.16)}
    data = cube(spark, [(t, y, x, 1.0 if (t, y, x) in on else 0.0) for t, y, x in itertools.product(*map(range, shape))])
    labelled = T.label_tubes(index_cube(data).withColumn("mask", F.col("value") > 0), connectivity).collect()
    groups: dict = {}
    for r in labelled:
        groups.setdefault(r["tube_id"], set()).add((r["t_idx"], r["y_idx"], r["x_idx"]))
    assert {frozenset(g) for g in groups.values()} == _components(on, connectivity)
    order = sorted(groups, key=lambda k: min(groups[k]))
    assert order == list(range(1, len(groups) + 1))


def test_tube_hull_of_a_square(spark):
    pts = [(1, D0, float(y), float(x)) for y in range(3) for x in range(3)] + [(2, D0, 0.0, 0.0)]
    got = T.tube_sections(spark.createDataFrame(pts, "tube_id bigint, time date, y double, x double")).collect()
    assert len(got) == 1 and len(got[0]["ring"]) == 4


def test_tubes_never_broadcast_their_stages(spark):
    """Stage files are far smaller than their rows, so file sizes must not choose broadcasts through the driver."""
    data = spark.createDataFrame([(D0, 0.0, 0.0, 1.0), (D0, 0.0, 1.0, 1.0), (D0, 5.0, 5.0, 1.0)], "time date, y double, x double, value double") \
        .withColumns({"y_idx": F.col("y").cast("long"), "x_idx": F.col("x").cast("long")})
    plan = T.label_tubes(index_cube(data).withColumn("mask", F.col("value") > 0), 26)._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert plan.count("SortMergeJoin") >= 3
    assert all("[_c#" in line for line in hashed)  # the base of the numbering: a fourth root of the voxel count


def test_user_statistic_packs_a_cell_once(spark):
    made = [(D0 + dt.timedelta(d), float(y), 0.0, None if (d + y) % 5 == 0 else float((d * 7 + y * 3) % 11)) for d in (0, 1, 2, 4, 5, 9) for y in range(3) if d != 4 or y]
    cube = spark.createDataFrame(made, "time date, y double, x double, value double").withColumns({"y_idx": F.col("y").cast("long"), "x_idx": F.col("x").cast("long")})
    out = V.rolling_pairwise_stat(cube, lambda x, y: x.max() - y.min() if len(x) else float("nan"), 4, 3)
    at = {(t, y): v for t, y, _, v in made}
    want = []
    for d in (2, 4, 5):  # three or more days of the axis in the window
        for y in range(3):
            inside = [(at[t, float(y)], at.get((t, 1.0))) for t in (D0 + dt.timedelta(k) for k in range(d - 4, d + 1)) if (t, float(y)) in at]
            both = [(a, b) for a, b in inside if a is not None and b is not None]
            want.append((D0 + dt.timedelta(d), y, max(a for a, _ in both) - min(b for _, b in both) if both else None))
    assert rows(out, "window_end", "y_idx", "value") == want
    assert "AggregateInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # a Python call and a copy a window before
