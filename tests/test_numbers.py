"""Order statistics, neighbours, components and regressions against numpy."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spacetide.functions import arrays as A
from spacetide.functions import ranking as R
from spacetide.operators import activity, joins, models as M, neighbors, population as P


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(700, 3.0), rng.exponential(5, 500).round(2), [np.nan]])
    groups = np.where(np.arange(len(values)) % 5 == 0, "a", "b")
    pdf = pd.DataFrame({"id": range(len(values)), "g": groups, "v": values})
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_quantiles_are_exact_under_ties(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert R.quantiles(df, "v", probs) == pytest.approx(np.nanquantile(pdf["v"], probs))
    table = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in R.quantile_table(df, "v", probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert table[g] == pytest.approx(np.nanquantile(part["v"], probs))


def test_average_ranks(skewed):
    pdf, df = skewed
    got = dict(rows(R.with_average_rank(df, "v", "r", ["g"]), "id", "r"))
    want = pdf.groupby("g")["v"].rank()
    assert all(got[i] == pytest.approx(want[i]) if want[i] == want[i] else got[i] is None for i in pdf["id"])


def test_qcut_drops_duplicate_edges(skewed):
    pdf, df = skewed
    got = dict(rows(R.qcut(df.where("v is not null"), "v", 4, "b"), "id", "b"))
    want = pd.qcut(pdf["v"].dropna(), 4, labels=False, duplicates="drop")
    assert all(got[i] == want[i] for i in want.index)


def test_event_aligned_quantiles_fixture(spark):
    df = spark.createDataFrame([(-1, 10.0), (-1, 20.0), (0, 30.0)], "o int, t double")
    assert rows(P.event_aligned_quantiles(df, "t", "o", (0.5,)), "o", "count", "q50") == [(-1, 2, 15.0), (0, 1, 30.0)]


def test_medoid_fixture_and_brute_force(spark):
    df = spark.createDataFrame([("a", "west", 10.0, 12.0), ("b", "west", 11.0, 13.0), ("c", "east", 80.0, 5.0)], "fire_id string, region string, x double, y double")
    assert P.medoid(df.where("region = 'west'"), ["x", "y"]).first()["fire_id"] == "a"
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(size=(300, 2)), np.zeros((40, 2))])
    big = spark.createDataFrame(pd.DataFrame({"fire_id": [f"{i:04d}" for i in range(len(pts))], "x": pts[:, 0], "y": pts[:, 1]}))
    total = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)).sum(1).round(6)
    assert P.medoid(big, ["x", "y"]).first()["fire_id"] == f"{int(total.argmin()):04d}"


@pytest.mark.parametrize("leaf", [4096, 20])
def test_knn_join_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbors, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(size=(150, 3)), np.zeros((60, 3)), rng.normal(3, 0.01, size=(40, 3))]).round(4)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(pts)), "a": pts[:, 0], "b": pts[:, 1], "c": pts[:, 2]}))
    got = rows(neighbors.knn_join(df, df, 4, ["a", "b", "c"]), "query_id", "rank", "neighbor_id")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)).round(9)
    want = []
    for i in range(len(pts)):
        order = sorted((d[i, j], j) for j in range(len(pts)) if j != i)[:4]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(order)]
    assert got == sorted(want)


def test_radius_pairs_across_the_dateline(spark):
    pl = [(i, y, x) for i, (y, x) in enumerate([(10.0, 179.9), (10.0, -179.9), (88.9, 10.0), (88.9, -170.0), (0.0, 0.0)])]
    df = spark.createDataFrame([(i, 0, i, y, x, "") for i, y, x in pl], "space bigint, y_idx bigint, x_idx bigint, y double, x double, label string")
    assert rows(joins.spatial_pairs(df, "neighbors", radius=300), "source", "target") == [(0, 1), (2, 3)]
    assert joins.spatial_pairs(df, "all_pairs").count() == 10


def test_rasterize_keeps_unobserved_null(spark):
    import datetime as dt

    d = dt.date(2020, 1, 1)
    grid = spark.createDataFrame([(d, y, x) for y in (0.0, 1.0) for x in (0.0, 1.0)], "time date, y double, x double")
    obs = spark.createDataFrame([(d, 0.5, 0.9, 0.0)], "date date, y double, x double, value double")
    got = rows(joins.rasterize_observations(obs, grid), "y", "x", "value")
    assert got == [(0.0, 0.0, None), (0.0, 1.0, 0.0), (1.0, 0.0, None), (1.0, 1.0, None)]


def test_exact_alignment_refuses_a_mismatch(spark):
    a, b = spark.range(3).toDF("time"), spark.range(4).toDF("time")
    with pytest.raises(ValueError):
        joins.align_join(a, b, how="exact")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4)) @ rng.normal(size=(4, 4)) + [1, 2, 3, 4]
    pdf = pd.DataFrame(x, columns=list("pqrs")).assign(fire_id=[str(i) for i in range(600)], year=2000 + np.arange(600) % 20, region=np.array(["w", "e", "c"])[np.arange(600) % 3])
    pdf["y"] = pdf["p"] * 2 - pdf["q"] + rng.normal(0, 0.5, 600)
    return pdf, spark.createDataFrame(pdf)


def test_pca_is_centred_on_medians(matrix):
    pdf, df = matrix
    cols = list("pqrs")
    fit = M.pca(df, cols)
    x = pdf[cols]
    z = ((x - x.median()) / x.std(ddof=0)).to_numpy()
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert fit.ratios == pytest.approx(s**2 / (s**2).sum())
    assert np.abs(fit.loadings.T @ vt.T).round(6) == pytest.approx(np.eye(4), abs=1e-6)
    score = dict(rows(fit.scores(df, 1), "fire_id", "morph_pc1"))
    want = z @ fit.loadings[:, 0]
    assert [score[str(i)] for i in range(600)] == pytest.approx(want)


def test_ridge_from_moments_equals_direct_fit(matrix):
    pdf, df = matrix
    got = M.ridge_cv(df, list("pqrs"), "y", "region_block")
    folds = pdf["region"].map({"c": 0, "e": 1, "w": 2}).to_numpy()
    x, y = pdf[list("pqrs")].to_numpy(), pdf["y"].to_numpy()
    pred = np.zeros(600)
    for f in range(3):
        tr, te = folds != f, folds == f
        mu, sd = x[tr].mean(0), x[tr].std(0)
        xt = np.c_[np.ones(tr.sum()), (x[tr] - mu) / sd]
        pen = np.eye(5)
        pen[0, 0] = 0
        beta = np.linalg.pinv(xt.T @ xt + pen) @ xt.T @ y[tr]
        pred[te] = np.c_[np.ones(te.sum()), (x[te] - mu) / sd] @ beta
    assert got["r2"] == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert M.ridge_cv(df.limit(50), list("pq"), "y", "random_fire")["r2"] is None


def test_bootstrap_replicates_stay_near_the_reference(matrix):
    _, df = matrix
    out = M.pca_bootstrap(df, list("pqrs"), ["region"], reps=5).toPandas()
    assert len(out) == 5 and (out["subspace_overlap"] > 0.9).all() and (out["mean_loading_cosine"] > 0.7).all()


def test_permutation_keeps_margins_and_breaks_correlation(matrix):
    pdf, df = matrix
    perm = M.feature_permutation(df, list("pqrs"), 1).toPandas()
    assert sorted(perm["p"].round(9)) == pytest.approx(sorted(pdf["p"].round(9)))
    assert abs(np.corrcoef(perm["p"], perm["y"] if "y" in perm else perm["q"])[0, 1]) < 0.2


def test_spearman_p_value():
    # t = 2.0 with 10 degrees of freedom: two-sided p = 0.0734
    rho = 2.0 / np.sqrt(10 + 4.0)
    assert M.t_test_p(rho, 12) == pytest.approx(0.07338803477074, abs=1e-9)


def test_clusters_of_correlated_features(matrix):
    _, df = matrix
    twin = df.withColumn("p2", F.col("p") * 2 + 1)
    assert len(M.correlated_clusters(twin.withColumn("n", F.rand(3)), ["p", "p2", "n"])) == 2


def _prominences(v, least):
    out, n, i = [], len(v), 1
    while i < n - 1:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if j < n - 1 and v[i - 1] < v[i] > v[j + 1]:
            mid = (i + j) // 2
            left, k = v[mid], mid
            while k >= 0 and v[k] <= v[mid]:
                left, k = min(left, v[k]), k - 1
            right, k = v[mid], mid
            while k < n and v[k] <= v[mid]:
                right, k = min(right, v[k]), k + 1
            if v[mid] - max(left, right) >= least:
                out.append(mid)
        i = j + 1
    return out


def test_prominent_peaks(spark):
    rng = np.random.default_rng(4)
    series = [[float(x) for x in rng.integers(0, 6, rng.integers(3, 14))] for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, v array<double>")
    got = {r["i"]: list(r["p"]) for r in df.select("i", activity.prominent_peaks(F.col("v"), F.lit(2.0)).alias("p")).collect()}
    assert got == {i: _prominences(s, 2.0) for i, s in enumerate(series)}


def test_array_functions(spark):
    v = [1.0, 4.0, 2.0, 8.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    c = F.col("v")
    row = df.select(A.interp(c, 0.4).alias("i"), A.gradient(c).alias("g"), A.diff(c).alias("d"), A.quantile(c, 0.3).alias("q"), A.run_starts(F.transform(c, lambda x: x > 1.5)).alias("r")).first()
    assert row["i"] == pytest.approx(np.interp(0.4, np.linspace(0, 1, 4), v))
    assert list(row["g"]) == pytest.approx(np.gradient(v)) and list(row["d"]) == [3.0, -2.0, 6.0]
    assert row["q"] == pytest.approx(np.quantile(v, 0.3)) and list(row["r"]) == [1]


def test_quantiles_of_groups_far_apart(spark):
    """Each group has its own cut points, so its quantiles are exact wherever its values lie."""
    rng = np.random.default_rng(21)
    groups = {"small": rng.uniform(0, 1, 3000), "large": 1e6 + rng.pareto(1.0, 500), "one": np.array([5.0])}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "metric string, value double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in R.quantile_table(frame, "value", probs, ["metric"]).collect():
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(groups[r.metric], probs)))
    counts = R.ordered_counts(frame, "value", ["metric"])
    assert {r.metric: r.total for r in counts.select("metric", "total").distinct().collect()} == {k: len(v) for k, v in groups.items()}


def test_cuts_depend_on_values_alone(spark):
    """A sketch merged in another order cuts elsewhere, and the two sides of a join then disagree on the buckets."""
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.abs(F.xxhash64("id")) % 1_000_003).cast("double").alias("v"))
    turned = df.repartition(7, F.hash("v")).unionByName(df.limit(100))
    cuts = [{r["g"]: r["_cuts"] for r in R.cut_points(rows_, "v", ["g"], 8).collect()} for rows_ in (df, turned)]
    assert cuts[0] == cuts[1] and all(4 <= len(c) < 8 and c == sorted(c) for c in cuts[0].values())
    pdf = df.toPandas()
    table = {r["g"]: r["q0"] for r in R.quantile_table(turned.where("g = 1"), "v", [0.5], ["g"]).collect()}
    extra = turned.toPandas()
    assert table[1] == pytest.approx(np.median(extra["v"][extra["g"] == 1]), abs=1e-9) and len(extra) == len(pdf) + 100


def test_matches_of_many_pairs_at_once():
    """All pairs of a batch are matched together, as a walk through each pair's candidates matches them."""
    from spacetide.operators.events import greedy_matches

    rng = np.random.default_rng(8)
    ns, nt = rng.integers(0, 9, 300), rng.integers(0, 9, 300)

    def side(n, base):
        ids = iter(range(base, base + int(n.sum())))
        return np.array([[d, next(ids), d, d + 1, 2] for k in n for d in np.sort(rng.integers(0, 25, k))], np.int64)

    s, t = side(ns, 0), side(nt, 5_000)
    got = list(zip(*(x.tolist() for x in greedy_matches(s, ns, t, nt, 4))))
    want = []
    for p, (a, b) in enumerate(zip(np.cumsum(ns) - ns, np.cumsum(nt) - nt)):
        ways = sorted((abs(t[j, 0] - s[i, 0]), s[i, 1], t[j, 1], i, j) for i in range(a, a + ns[p]) for j in range(b, b + nt[p]) if abs(t[j, 0] - s[i, 0]) <= 4)
        used = set()
        for _, u, v, i, j in ways:
            if u not in used and v not in used:
                used |= {u, v}
                want.append((p, i, j))
    assert got == want and len(got) > 300


def test_group_ranks_and_correlation():
    from spacetide.operators.synchrony import group_correlation, group_ranks

    rng = np.random.default_rng(3)
    at, x, y = rng.integers(0, 40, 400), rng.integers(0, 6, 400).astype(float), rng.normal(size=400)
    n = np.bincount(at, minlength=41)
    u, v = group_ranks(at, x), group_ranks(at, y)
    r = group_correlation(at, n, u, v)
    frame = pd.DataFrame({"g": at, "x": x, "y": y})
    assert u.tolist() == frame.groupby("g")["x"].rank().tolist() and np.isnan(r[40])
    for g, part in frame.groupby("g"):
        assert r[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), nan_ok=True)


def test_number_below_halves(spark):
    """Places among ascending cuts, for every count of cuts and with the number of steps that a table of 200 buckets needs."""
    cuts = [[float(2 * i) for i in range(n)] for n in range(9)]
    table = spark.createDataFrame([(c, float(v)) for c in cuts for v in range(-1, 18)], "cuts array<double>, v double")
    for r in table.withColumn("n", R.number_below("cuts", F.col("v"), 200)).collect():
        assert r["n"] == sum(c < r["v"] for c in r["cuts"])


def test_medoid_bounds_hold_and_stay_narrow_in_long_cells(spark):
    rng = np.random.default_rng(5)
    pts = np.round(np.c_[rng.gamma(2.0, 120.0, 3000), 24.0 * rng.integers(1, 2400, 3000)], 6)  # far longer than wide
    cell = np.minimum(pts[:, 1] // 2400, 23).astype(int)
    groups = [pts[cell == k] for k in np.unique(cell)]
    n, m = np.array([len(g) for g in groups], float), np.array([g.mean(axis=0) for g in groups])
    off = [g - g.mean(axis=0) for g in groups]
    h = np.array([np.abs(o).max(axis=0) for o in off])
    c = {(i, j): np.array([(o[:, i] * o[:, j]).sum() for o in off]) for i in range(2) for j in range(i, 2)}
    low, high = P._sum_bounds(pts[:300], n, m, h, c)
    true = np.sqrt(((pts[:300, None] - pts[None]) ** 2).sum(axis=2)).sum(axis=1)
    d = np.sqrt(((pts[:300, None] - m[None]) ** 2).sum(axis=2))
    plain = np.sqrt(d * d + (c[0, 0] + c[1, 1]) / n) @ n
    assert (low <= true + 1e-6).all() and (true <= high + 1e-6).all()
    assert ((high - low) < 0.9 * (plain - low)).all()
    assert P._cuts_by_spread([500.0, 50_000.0], 10_000) == [10, 1000]
    df = spark.createDataFrame([(str(i), "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(pts)], "fire_id string, g string, x double, y double")
    got = rows(P.medoid(df, ["x", "y"], by="g"), "g", "fire_id")
    full = np.round(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2)), 12)
    assert got == [(g, str(min(range(k, 3000, 2), key=lambda i: (round(full[i, k::2].sum(), 6), str(i))))) for k, g in enumerate("ab")]


def test_radius_with_k_brings_only_the_nearest_of_places_beyond_degrees(spark):
    cells = [(y * 10 + x, float(y), float(x)) for y in range(87, 99) for x in range(10)]  # degrees end at 90; four neighbours tie
    p = spark.createDataFrame(cells, "space long, y double, x double").repartition(7, "space")

    def km(a, b):
        if abs(a[1]) > 90 or abs(b[1]) > 90:
            return float(np.hypot(a[1] - b[1], a[2] - b[2]))
        u, v = np.radians(a[1:]), np.radians(b[1:])
        return float(2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((v[0] - u[0]) / 2) ** 2 + np.cos(u[0]) * np.cos(v[0]) * np.sin((v[1] - u[1]) / 2) ** 2)))

    want = set()
    for a in cells:
        near = sorted((round(km(a, b), 9), b[0]) for b in cells if b is not a and km(a, b) <= 120)[:3]
        want |= {(min(a[0], t), max(a[0], t)) for _, t in near}
    assert rows(joins.spatial_pairs(p, "neighbors", radius=120, k=3), "source", "target") == sorted(want)
    per_place = joins._near_candidates(p, 120.0, 3).where("source > 910").groupBy("source").count().agg(F.max("count")).first()[0]
    assert per_place <= 3  # each met every place within the radius before


def test_medians_of_overlapping_kinds_read_the_rows_once(spark):
    from spacetide.functions.ranking import weighted_medians

    values = [(i * 37 % 101 / 4.0, i % 10) for i in range(5000)] + [(None, 0)]
    df = spark.createDataFrame(values, "v double, g int").repartition(3)
    kinds = [F.col("g") >= 0, F.col("g") > 2, F.col("g") == 7, F.col("g") > 50]
    got = weighted_medians(df, "v", kinds).first()["medians"]
    for m, test in zip(got, (lambda g: g >= 0, lambda g: g > 2, lambda g: g == 7, lambda g: g > 50)):
        own = sorted(v for v, g in values if v is not None and test(g))
        assert m == ((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2 if own else None)
