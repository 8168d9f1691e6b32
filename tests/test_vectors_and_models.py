"""Neighbours of long vectors, farthest points, scanlines and one-pass models against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from spacetide.operators import hull, neighbors, vectors
from spacetide.operators import models as M


@pytest.fixture(scope="module")
def cloud():
    """Six clusters in 20 dimensions, a fifth of the points equal."""
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(6, 20)) * 3)[rng.integers(0, 6, 600)] + rng.normal(size=(600, 20))
    x[400:520] = x[7]
    return x


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("itself", [True, False])
def test_pivot_join_equals_brute_force(spark, cloud, monkeypatch, itself):
    monkeypatch.setattr(vectors, "CELL_POINTS", 60)
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 40)
    monkeypatch.setattr(vectors, "QUERIES_PER_TASK", 50)
    df = _frame(spark, cloud)
    odd = spark.createDataFrame([(9000, None), (9001, [float("nan")] * 20), (9002, [None] * 20)], "id long, v array<double>")
    got = rows(neighbors.knn_join(df.union(odd), df, 4, "v", exclude_self=itself), "query_id", "rank", "neighbor_id", "distance")
    want = []
    for i in range(len(cloud)):
        d = np.round(np.sqrt(((cloud - cloud[i]) ** 2).sum(axis=1)), 9)
        near = [j for j in np.lexsort((np.arange(len(d)), d)) if not (itself and j == i)][:4]
        want += [(i, r + 1, int(j), float(d[j])) for r, j in enumerate(near)]
    assert got == want


def test_pivots_rule_out_most_pairs(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_POINTS", 60)
    df = _frame(spark, cloud)
    work = vectors.pivot_join(df, df, 4, "v", work=True).first()
    assert work["looked_at"] < work["all_pairs"] / 2 and work["in_full"] <= work["looked_at"]
    assert vectors.pivot_join(df.where("id < 0"), df, 4, "v").count() == 0


@pytest.mark.parametrize("pool", [8, 2048])
def test_farthest_points_with_any_pool(spark, cloud, monkeypatch, pool):
    monkeypatch.setattr(M, "POOL", pool)
    x = np.unique(np.round(cloud, 4), axis=0)
    got = M.farthest_points(_frame(spark, x), np.zeros(20).tolist(), 25)
    away = np.round((x**2).sum(axis=1), 9)
    chosen = [max(np.flatnonzero(away == away.min()))]
    least = np.full(len(x), np.inf)
    while len(chosen) < 25:
        least = np.minimum(least, np.round(((x - x[chosen[-1]]) ** 2).sum(axis=1), 9))
        chosen.append(max(np.flatnonzero(least == least.max())))
    assert [i for i, _ in got] == [int(c) for c in chosen]
    assert len(M.farthest_points(_frame(spark, x[:3]), np.zeros(20).tolist(), 25)) == 3


def test_scanline_equals_point_tests(spark):
    rng = np.random.default_rng(2)
    shapes = [[(0.0, 0.0), (9.0, 1.0), (5.0, 4.0), (9.0, 8.0), (1.0, 7.0), (3.0, 3.5)], [(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0)], [(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)], [(50.0, 50.0), (60.0, 50.0), (55.0, 60.0)]]
    shapes += [[(float(a), float(b)) for a, b in zip(5 + r * np.cos(t), 5 + r * np.sin(t))] for r, t in ((rng.uniform(1, 5, 9), np.sort(rng.uniform(0, 6.28, 9))) for _ in range(4))]
    df = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in s]) for i, s in enumerate(shapes)], "k int, ring array<struct<x: double, y: double>>")
    found = hull.zonal_cells(df, ["k"], x0=0.0, dx=0.5, nx=21, y0=0.0, dy=0.5, ny=21)
    got = set(rows(found.where("sample_method = 'grid_cells_inside_zone'"), "k", "ix", "iy"))

    def inside(s, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(s, s[1:] + s[:1]):
            side = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax))
            if side <= 1e-9 * max(np.hypot(bx - ax, by - ay), 1) and min(ax, bx) - 1e-9 <= x <= max(ax, bx) + 1e-9 and min(ay, by) - 1e-9 <= y <= max(ay, by) + 1e-9:
                return False
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    assert got == {(k, i, j) for k, s in enumerate(shapes) for i in range(21) for j in range(21) if inside(s, i * 0.5, j * 0.5)}
    rest = dict(rows(found.where("sample_method <> 'grid_cells_inside_zone'"), "k", "sample_method"))
    assert rest == {2: "fallback_nearest_cell_to_zone", 3: "outside_grid"}


def test_next_day_models_equal_separate_fits(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(n, 7)), columns=["t", "w", "h", *M.STATE])
    pdf["next_growth_log1p"] = pdf["t"] + 0.5 * pdf["current_growth_log1p"] + 0.3 * pdf["t"] * pdf["elapsed_day"] + rng.normal(size=n)
    pdf["fire_id"], pdf["year"], pdf["region"] = [f"f{i // 3}" for i in range(n)], 2001 + np.arange(n) % 20, [f"r{i % 4}" for i in range(n)]
    df = spark.createDataFrame(pdf)
    got = {(r.predictor_set, r.block): r.r2 for r in M.next_day_models(df, ["t", "w"], ["t", "w", "h"]).collect()}
    assert len(got) == 24 and got["core climate-state interaction", "random_fire"] > got["core climate plus state", "random_fire"] > got["state only", "random_fire"]
    for name, cols in (("core climate only", ["t", "w"]), ("expanded climate plus state", ["t", "w", "h", *M.STATE])):
        for kind in M.FOLD_KINDS:
            assert got[name, kind] == pytest.approx(M.ridge_cv(df, cols, "next_growth_log1p", kind)["r2"], abs=1e-9)


def test_spectra_equal_separate_components(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)) * [1, 5, 2, 1], columns=list("pqrs"))
    pdf["g"] = np.arange(400) % 3
    pdf.loc[5, "p"] = np.nan
    df = spark.createDataFrame(pdf)
    found = M.spectra(df, list("pqrs"), "g")
    for g in range(3):
        one = M.pca(df.where(F.col("g") == g), list("pqrs"))
        assert found[str(g)][0] == one.n and found[str(g)][1] == pytest.approx(one.ratios, abs=1e-9)


def test_partners_in_hash_order_are_one_cycle(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    placed = rows(M.hash_order(df, "k", "place"), "place", "k")
    assert [p for p, _ in placed] == list(range(300)) and [k for _, k in placed] != list(range(300))


def test_exposure_areas_equal_counted_cells(spark):
    import datetime as dt

    from spacetide.operators import geometry as G

    rng = np.random.default_rng(8)
    data = [(f"f{i % 4}", dt.date(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 6))), *rng.uniform(0, 30_000, 2).tolist(), float(rng.uniform(500, 6_000))) for i in range(40)]
    df = spark.createDataFrame(data, "fire_id string, date date, x double, y double, r double")
    df = df.select("fire_id", "date", G.regular_ring(F.col("x"), F.col("y"), F.col("r"), 9).alias("ring"))
    cols = ["fire_id", "date", "exposure_zone", "extension_distance_m", "exposure_area_km2"]
    for distances, cell in (([2000.0, 5500.0], 1000.0), ([1500.0], 2000.0)):
        cells = hull.exposure_zones(df, distances, cell).distinct()
        assert rows(hull.exposure_areas(df, distances, cell), *cols) == rows(hull.zone_areas(cells, cell), *cols)


def test_near_pairs_of_a_block_are_cut_as_they_are_found():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.zeros((3000, 64))
    x[:, : vectors.PREFIX_AXES] = rng.normal(size=(3000, vectors.PREFIX_AXES))
    cells = vectors.Cells(x[:500], 4)
    d = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    limit = np.full(len(x), np.quantile(d, 0.1))  # a tenth of all pairs lies within: 0.9 million
    mine = pd.DataFrame({"v": list(x), "ids": [[i] for i in range(len(x))]})
    tracemalloc.start()
    found, _, full = vectors._lists(mine[["v"]], mine, cells, limit, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert full < 2_000_000 and peak < 200 << 20
    for i in range(0, 200, 20):
        assert [r["ids"][0] for r in found[i]] == np.argsort(d[i], kind="stable")[:6].tolist()


def test_group_medians_are_exact_whatever_is_drawn(spark, monkeypatch):
    """Ties, missing values and empty columns; few drawn rows, missed brackets and full ones give the same medians, by sending few values."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"_g": [f"g{i}" for i in rng.integers(0, 3, 9000)], "a": rng.normal(size=9000), "b": rng.integers(0, 3, 9000).astype(float), "c": np.nan, "d": rng.exponential(size=9000) * (rng.random(9000) < 0.6)})
    pdf.loc[rng.random(9000) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(pdf).select("_g", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcd"]).repartition(4).cache()
    plain = {g: np.nan_to_num(part[list("abcd")].median().to_numpy()) for g, part in pdf.groupby("_g")}
    for drawn, most, gathered in ((20_000, 1 << 22, 1 << 20), (200, 1 << 22, 100), (1, 1 << 22, 1 << 20), (500, 20, 1 << 20)):
        for name, value in (("DRAWN", drawn), ("MOST", most), ("GATHERED", gathered)):
            monkeypatch.setattr(M, name, value)
        got = M.group_medians(df, list("abcd"))
        assert sorted(got) == sorted(plain) and all(got[g] == pytest.approx(plain[g], abs=1e-12) for g in plain)


def test_a_query_is_sent_once_for_all_blocks_of_a_group(spark, monkeypatch):
    """Many small blocks in a few groups: the neighbours are those of all pairs, and a query travels at most once a group."""
    monkeypatch.setattr(vectors, "CELL_POINTS", 40)
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 60)
    monkeypatch.setattr(vectors, "GROUP_POINTS", 300)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 20)), 1)
    x[::7] = x[0]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    for k in (1, 4):
        got = rows(vectors.pivot_join(df, df, k, "v"), "query_id", "rank", "neighbor_id")
        assert got == [(i, r + 1, int(j)) for i in range(900) for r, j in enumerate(np.lexsort((np.arange(900), d[i]))[:k])]
    cells = vectors.Cells(x[:400], 22)
    cells.describe([{"cell": c, "n": 40, "low": 0.0, "high": 9.0} for c in range(len(cells.pivots))])
    assert len(cells.group) == cells.blocks.sum() and (np.diff(cells.group) >= 0).all() and cells.group[-1] + 1 < cells.blocks.sum() / 5
