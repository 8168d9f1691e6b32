"""Exact k-nearest-neighbour join in a feature space; up to TREE_AXES columns by the tree below, beyond by ``vectors``.

Equal coordinates are merged first (a population can hold millions of identical
points), the rest is cut into leaves of a split tree. The tree comes from a
bounded sample; the leaves only decide where work happens, never the result:

1. every query finds its k best inside its own leaf, which bounds its search ball;
2. the ball is sent only to the other leaves it touches;
3. the lists are merged.

Numpy runs inside one leaf at a time; Spark partitions and shuffles the leaves,
and a leaf that attracts many foreign queries is split by salt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..session import cut_lineage
from .vectors import pivot_join

TREE_AXES = 6
LEAF_POINTS = 4096
SAMPLE_PER_LEAF = 16
MAX_LEAVES = 1 << 17
FOREIGN_PER_TASK = 50_000


class SplitTree:
    """Axis-aligned splits as flat arrays: node -> (dim, threshold, left, right) or leaf id."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self._grow(sample, leaves)

    def _grow(self, pts: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        self.dim.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        self.leaf.append(-1)
        spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(1)
        if leaves <= 1 or len(pts) < 4 or spread.max() <= 0:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        d = int(spread.argmax())
        cut = float(np.median(pts[:, d]))
        low = pts[:, d] <= cut
        if low.all():
            cut = float((pts[:, d].min() + cut) / 2)
            low = pts[:, d] <= cut
        self.dim[node], self.cut[node] = d, cut
        a = self._grow(pts[low], leaves // 2)
        b = self._grow(pts[~low], leaves - leaves // 2)
        self.kids[node] = (a, b)
        return node

    def assign(self, pts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pts), dtype=np.int64)
        todo = [(0, np.arange(len(pts)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.dim[node] < 0:
                out[idx] = self.leaf[node]
                continue
            low = pts[idx, self.dim[node]] <= self.cut[node]
            todo += [(self.kids[node][0], idx[low]), (self.kids[node][1], idx[~low])]
        return out

    def touched(self, pts: np.ndarray, radius: np.ndarray) -> list[list[int]]:
        """Leaves each ball reaches."""
        out: list[list[int]] = [[] for _ in range(len(pts))]
        todo = [(0, np.arange(len(pts)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.dim[node] < 0:
                for i in idx:
                    out[i].append(self.leaf[node])
                continue
            gap = pts[idx, self.dim[node]] - self.cut[node]
            todo += [
                (self.kids[node][0], idx[gap <= radius[idx]]),
                (self.kids[node][1], idx[-gap <= radius[idx]]),
            ]
        return out


def _best(queries: np.ndarray, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and rounded distances of the k nearest targets, earlier ones first on ties, in blocks of bounded size."""
    k = min(k, len(targets))
    rows, dists = [], []
    step = max(1, 4_000_000 // max(1, len(targets)))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        sq = np.zeros((len(q), len(targets)))
        for d in range(q.shape[1]):
            sq += (q[:, d : d + 1] - targets[None, :, d]) ** 2
        dist = np.round(np.sqrt(sq), 9)
        order = np.lexsort((np.broadcast_to(np.arange(len(targets)), dist.shape), dist), axis=1)[:, :k]
        rows.append(order)
        dists.append(np.take_along_axis(dist, order, axis=1))
    return np.vstack(rows), np.vstack(dists)


def _merged_points(df: DataFrame, cols: Sequence[str], id_col: str, keep: int) -> DataFrame:
    """One row per distinct coordinate with its ``keep`` smallest ids (salted in two rounds)."""
    salt = F.pmod(F.xxhash64(id_col), F.lit(64))
    first = df.withColumn("_salt", salt).withColumn(
        "_r", F.row_number().over(W.partitionBy(*cols, "_salt").orderBy(id_col))
    )
    second = first.where(F.col("_r") <= keep).withColumn(
        "_r", F.row_number().over(W.partitionBy(*cols).orderBy(id_col))
    )
    return second.where(F.col("_r") <= keep).groupBy(*cols).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def knn_join(targets: DataFrame, queries: DataFrame, k: int, cols: Sequence[str] | str, *, id_col: str = "id", exclude_self: bool = True) -> DataFrame:
    """k nearest targets of every query: query_id, neighbor_id, distance, rank (1-based).

    ``cols``: the coordinates' columns, or one array column of them. Distances are rounded to 9 digits; ties go to the smaller id. Starts three
    bounded jobs: a count, a sample for the tree, and the step that is cut.
    """
    spark = targets.sparkSession
    if isinstance(cols, str) or len(cols) > TREE_AXES:
        return pivot_join(targets, queries, k, cols, id_col=id_col, exclude_self=exclude_self)
    cols = list(cols)
    extra = k + 1 if exclude_self else k
    id_type = dict(targets.dtypes)[id_col]

    def clean(df: DataFrame) -> DataFrame:
        # -0.0 and 0.0 are the same coordinate
        df = df.select(F.col(id_col), *[(finite(c) + F.lit(0.0)).alias(c) for c in cols])
        return df.dropna(subset=cols)

    targets, queries = clean(targets), clean(queries)
    merged = cut_lineage(_merged_points(targets, cols, id_col, extra), "knn-targets")
    places = queries.select(*cols).distinct()
    n = merged.count()
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF_POINTS)))
    rate = min(1.0, leaves * SAMPLE_PER_LEAF * 4 / max(n, 1)) if leaves > 1 else 0.0
    sample = (
        merged.sample(rate, seed=7).select(*cols).toPandas().to_numpy(float)
        if leaves > 1
        else np.zeros((0, len(cols)))
    )
    tree = spark.sparkContext.broadcast(SplitTree(sample, leaves))

    def with_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["leaf"] = tree.value.assign(b[cols].to_numpy(float))
            yield b

    coord = ", ".join(f"`{c}` double" for c in cols)
    t = merged.mapInPandas(with_leaf, f"{coord}, ids array<{id_type}>, leaf long")
    q = places.mapInPandas(with_leaf, f"{coord}, leaf long")

    found_type = f"array<struct<distance: double, ids: array<{id_type}>>>"

    def pack(dist: np.ndarray, idx: np.ndarray, ids: list) -> list:
        return [
            [{"distance": float(x), "ids": ids[j]} for x, j in zip(dr, ir)] for dr, ir in zip(dist, idx)
        ]

    def by_id(mine: pd.DataFrame) -> pd.DataFrame:
        """Targets by their smallest id, which ties go to."""
        return mine.iloc[np.argsort(mine["ids"].str[0].to_numpy(), kind="stable")]

    none = pd.Series([], dtype=object)
    no_coord = {c: none.astype(float) for c in cols}

    def own_leaf(key: tuple, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({**no_coord, "found": none, "leaves": none})
        xy = asked[cols].to_numpy(float)
        radius = np.full(len(asked), np.inf)
        found: list = [[] for _ in range(len(asked))]
        if len(mine):
            mine = by_id(mine)
            ids = [list(v) for v in mine["ids"]]
            counts = np.array([len(v) for v in ids])
            idx, dist = _best(xy, mine[cols].to_numpy(float), extra)
            found = pack(dist, idx, ids)
            have = np.cumsum(counts[idx], axis=1) >= extra
            full = have.any(axis=1)
            at = have.argmax(axis=1)
            radius[full] = dist[full, at[full]] + 2e-9
        home = int(key[0])
        leaves = [[v for v in hit if v != home] for hit in tree.value.touched(xy, radius)]
        return pd.DataFrame({**{c: asked[c].to_numpy() for c in cols}, "found": found, "leaves": leaves})

    def dealt(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Targets and queries with a salt: as many tasks a leaf as its queries need, its targets in each."""
        load = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / FOREIGN_PER_TASK).cast("int").alias("_s"))
        salted = t.join(load, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
        return salted, asked.join(load, "leaf").withColumn("salt", F.pmod(F.xxhash64(*cols), F.col("_s")).cast("int")).drop("_s")

    own_t, own_q = dealt(q)
    near = own_t.groupBy("leaf", "salt").cogroup(own_q.groupBy("leaf", "salt")).applyInPandas(
        own_leaf, f"{coord}, found {found_type}, leaves array<long>"
    )
    near = cut_lineage(near, "knn-near")
    lists = near.select(*cols, "found")
    if leaves > 1:
        away = near.select(*cols, F.explode("leaves").alias("leaf"))
        salted_t, salted_q = dealt(away)

        def other_leaf(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if mine.empty or asked.empty:
                return pd.DataFrame({**no_coord, "found": none})
            mine = by_id(mine)
            idx, dist = _best(asked[cols].to_numpy(float), mine[cols].to_numpy(float), extra)
            ids = [list(v) for v in mine["ids"]]
            return pd.DataFrame({**{c: asked[c].to_numpy() for c in cols}, "found": pack(dist, idx, ids)})

        far = salted_t.groupBy("leaf", "salt").cogroup(salted_q.groupBy("leaf", "salt")).applyInPandas(
            other_leaf, f"{coord}, found {found_type}"
        )
        lists = lists.unionByName(far)
    # at most (leaves touched) lists of k entries per coordinate
    best = lists.groupBy(*cols).agg(F.flatten(F.collect_list("found")).alias("f"))
    flat = F.flatten(
        F.transform("f", lambda s: F.transform(s["ids"], lambda i: F.struct(s["distance"].alias("distance"), i.alias("id"))))
    )
    best = best.select(*cols, F.slice(F.array_sort(flat), 1, extra).alias("best"))
    # the k + 1 best of the coordinate contain the k best of each of its ids
    out = queries.join(best, cols)
    mine = F.filter("best", lambda s: s["id"] != F.col(id_col)) if exclude_self else F.col("best")
    return out.select(
        F.col(id_col).alias("query_id"), F.posexplode(F.slice(mine, 1, k)).alias("rank", "b")
    ).select("query_id", F.col("b.id").alias("neighbor_id"), F.col("b.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
