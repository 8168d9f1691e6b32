"""Exact k-nearest-neighbour join of long vectors.

A ball in dozens of dimensions touches every leaf of a split tree, so cells around
pivots take their place. Triangle inequalities on the distances to the pivots rule
out whole cells; inside a cell, distances over a few rotated axes (those of largest
variance) rule out most pairs before any is computed in full. Pivots and axes come
from a bounded sample and decide only where work happens, never the result:

1. every query finds its k best in one block of its own cell, which bounds its ball;
2. it is sent to the groups of blocks that its ball may reach, once for all blocks of a group;
3. the lists are merged.

What travels grows with queries times groups, so a group is as large, and takes as many queries, as a task can hold. Blocks hold a bounded number of targets whatever a cell attracts, and blocks that many
queries ask for are split by salt. ``knn_join`` of ``neighbors`` comes here above
``neighbors.TREE_AXES`` columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

CELL_POINTS = 8192
BLOCK_POINTS = 32_768
MAX_PIVOTS = 4096
SAMPLE_PER_PIVOT = 16
GROUP_POINTS = 65_536
QUERIES_PER_TASK = 16_384
LIST_ENTRIES = 262_144
PREFIX_AXES = 12
PAIRS_AT_ONCE = 1 << 20
EXACT_AT_ONCE = 1 << 16
_TIE = 2e-9  # distances are rounded to 9 digits


class Cells:
    """Pivots, rotated axes and what is known of the targets around each pivot."""

    def __init__(self, sample: np.ndarray, pivots: int):
        self.middle = sample.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
        self.axes = axes[:, ::-1]
        rng = np.random.default_rng(7)
        self.pivots = sample[np.sort(rng.choice(len(sample), min(pivots, len(sample)), replace=False))]
        for _ in range(3):
            own = self.nearest(sample)[0]
            filled = np.unique(own)
            self.pivots = np.array([sample[own == c].mean(axis=0) for c in filled])
        self.gaps = np.sqrt(((self.pivots[:, None, :] - self.pivots[None]) ** 2).sum(axis=2))

    def distances(self, x: np.ndarray) -> np.ndarray:
        x, p = x - self.middle, self.pivots - self.middle
        sq = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T
        return np.sqrt(np.clip(sq, 0, None))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.empty(len(x), np.int64)
        away = np.empty(len(x))
        step = max(1, PAIRS_AT_ONCE // len(self.pivots))
        for lo in range(0, len(x), step):
            d = self.distances(x[lo : lo + step])
            cell[lo : lo + step] = d.argmin(axis=1)
            away[lo : lo + step] = d.min(axis=1)
        return cell, away

    def describe(self, rows: list) -> None:
        """Targets, least and largest distance by cell."""
        n = len(self.pivots)
        self.count, self.low, self.high = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for r in rows:
            self.count[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
        self.blocks = -(-self.count // BLOCK_POINTS)
        self.first = np.cumsum(self.blocks) - self.blocks  # number of each cell's first block
        size = np.repeat(self.count / np.maximum(self.blocks, 1), self.blocks)
        self.group = ((np.cumsum(size) - size) // GROUP_POINTS).astype(np.int64)  # of each block; a group ends beyond its points by a block at most
        self.slack = 1e-6 * (1 + float(np.abs(self.pivots).max()))  # distances to pivots are computed fast, not exactly

    def reached(self, x: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """Numbers of the blocks that may hold a target within each radius."""
        out = []
        step = max(1, PAIRS_AT_ONCE // len(self.pivots))
        of = np.repeat(np.arange(len(self.blocks)), self.blocks)  # cell of each block
        for lo in range(0, len(x), step):
            d = self.distances(x[lo : lo + step])
            own = d.argmin(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - (d.min(axis=1) ** 2)[:, None]) / (2 * self.gaps[own])
            plane = np.where(np.isfinite(plane), plane, 0)
            least = np.maximum(np.maximum(d - self.high, self.low - d), plane)
            hit = (least <= radius[lo : lo + step, None] + self.slack) & (self.count > 0)
            out += [np.flatnonzero(row[of]).astype(np.int32) for row in hit]
        return out

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) @ self.axes


def _exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs of rows (r, c), to 9 digits."""
    out = np.empty(len(r))
    for lo in range(0, len(r), EXACT_AT_ONCE):
        part = slice(lo, lo + EXACT_AT_ONCE)
        out[part] = np.round(np.sqrt(((x[r[part]] - y[c[part]]) ** 2).sum(axis=1)), 9)
    return out


def _pairs_within(q: np.ndarray, t: np.ndarray, limit: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Candidate pairs (query, target) in rotated axes, some queries at a time: those within ``limit``, or around the k nearest; and pairs
    computed over all axes."""
    t_sq, head = (t**2).sum(axis=1), t[:, :PREFIX_AXES]
    h_sq = (head**2).sum(axis=1)
    step = max(1, PAIRS_AT_ONCE // max(1, len(t)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        p_sq = (part**2).sum(axis=1)
        margin = 1e-10 * (p_sq[:, None] + t_sq.max(initial=0)) + 1e-12
        if limit is not None:
            top = (limit[lo : lo + step, None] + _TIE) ** 2 + margin
            own = part[:, :PREFIX_AXES]
            near = (own**2).sum(axis=1)[:, None] + h_sq - 2 * own @ head.T <= top
            r, c = np.nonzero(near)
            if len(r) * 8 < near.size:
                yield r + lo, c, len(r)
                continue
        sq = p_sq[:, None] + t_sq - 2 * part @ t.T
        at = min(k, len(t)) - 1
        kth = (np.sqrt(np.clip(np.partition(sq, at, axis=1)[:, at : at + 1], 0, None)) + _TIE) ** 2 + 2 * margin
        top = kth if limit is None else np.minimum(top, kth)
        r, c = np.nonzero(sq <= top)
        yield r + lo, c, sq.size


def _lists(asked: pd.DataFrame, mine: pd.DataFrame, cells: Cells, limit: np.ndarray | None, k: int) -> tuple[list, np.ndarray, int]:
    """Per query its candidates as ``(distance, ids)`` in order, k distinct vectors at most; the distance by which k ids are found; pairs in full.

    The candidates of some queries are cut to k before those of the next are looked for.
    """
    x, y = np.stack(asked["v"]), np.stack(mine["v"])
    ids = [list(v) for v in mine["ids"]]
    many = np.array([len(v) for v in ids])
    first = np.array([v[0] for v in ids], dtype=object)
    by_id = np.argsort(np.argsort(first, kind="stable"), kind="stable")
    found, radius, full = [[] for _ in range(len(x))], np.full(len(x), np.inf), 0
    for r, c, n in _pairs_within(cells.turned(x), cells.turned(y), limit, k):
        full += n
        d = _exact(x, y, r, c)
        order = np.lexsort((by_id[c], d, r))
        r, c, d = r[order], c[order], d[order]
        begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
        for a, b in zip(begin, np.r_[begin[1:], len(r)]):
            i, b = r[a], min(b, a + k)
            found[i] = [{"distance": float(d[j]), "ids": ids[c[j]]} for j in range(a, b)]
            have = np.cumsum(many[c[a:b]])
            if have[-1] >= k:
                radius[i] = d[a + int(np.searchsorted(have, k))]
    return found, radius, full


def pivot_join(targets: DataFrame, queries: DataFrame, k: int, cols: Sequence[str] | str, *, id_col: str = "id", exclude_self: bool = True, work: bool = False) -> DataFrame:
    """k nearest targets of every query: query_id, neighbor_id, distance, rank (1-based).

    ``cols``: the coordinates' columns, or one array column of them. Distances are rounded to 9 digits; ties go to the smaller id. Rows with a missing or non-finite
    coordinate take no part. With ``work``: one row of pairs (all, looked at, computed over all axes) instead.
    """
    spark = targets.sparkSession
    extra = k + 1 if exclude_self else k
    id_type = dict(targets.dtypes)[id_col]

    def clean(df: DataFrame) -> DataFrame:
        # stored once as one array: a filter over dozens of derived columns would be inferred through every later step
        real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        v = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
        rows = df.select(F.col(id_col).alias("id"), v.alias("v"))
        return cut_lineage(rows.select("id", F.when(F.forall("v", real), F.transform("v", lambda x: x + F.lit(0.0))).alias("v")), "vectors").where("v IS NOT NULL")

    queries = clean(queries) if queries is not targets else None
    targets = clean(targets)
    queries = targets if queries is None else queries
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    kept = targets.withColumn("_s", salt).withColumn("_r", F.row_number().over(W.partitionBy("v", "_s").orderBy("id"))).where(F.col("_r") <= extra)
    kept = kept.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("_r") <= extra)
    merged = cut_lineage(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors-targets")
    places = cut_lineage(queries.select("v").distinct().withColumn("pid", F.monotonically_increasing_id()), "vectors-queries")
    n = merged.count()
    shape = f"query_id {id_type}, neighbor_id {id_type}, distance double, rank int"
    if not n:
        return spark.createDataFrame([], "all_pairs long, looked_at long, in_full long" if work else shape)
    pivots = int(min(MAX_PIVOTS, max(1, n // CELL_POINTS)))
    wanted = pivots * SAMPLE_PER_PIVOT + 1000
    sample = merged.select("v").sample(min(1.0, 2.0 * wanted / n), seed=7).limit(wanted).toPandas()["v"]  # bounded by MAX_PIVOTS
    sample = sample if len(sample) else merged.select("v").limit(1).toPandas()["v"]
    cells = Cells(np.stack(sample), pivots)
    first = spark.sparkContext.broadcast(cells)

    def with_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, away = first.value.nearest(np.stack(b["v"]))
                yield b.assign(cell=cell, away=away)

    t = cut_lineage(merged.mapInPandas(with_cell, f"v array<double>, ids array<{id_type}>, cell long, away double"), "vectors-cells")
    cells.describe(t.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect())  # a row a pivot
    known = spark.sparkContext.broadcast(cells)
    of_cell = lambda numbers: F.get(F.array(*[F.lit(int(b)) for b in numbers]), F.col("cell").cast("int"))
    t = t.withColumn("block", (of_cell(cells.first) + F.pmod(F.xxhash64("v"), of_cell(cells.blocks))).cast("int")).drop("away", "cell")

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = np.flatnonzero(known.value.count)
        for b in batches:
            if len(b):
                cell = filled[known.value.distances(np.stack(b["v"]))[:, filled].argmin(axis=1)]
                yield b.assign(block=known.value.first[cell] + b["pid"].to_numpy() % known.value.blocks[cell])

    q = places.mapInPandas(at_home, "v array<double>, pid long, block int")

    def dealt(asked: DataFrame, targets: DataFrame, by: str, most: int) -> tuple:
        """Targets and queries by (block or group, salt): as many salts as its queries need, its targets in each."""
        load = asked.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
        mine = targets.join(load, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        asked = asked.join(load, by).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("_n")).cast("int")).drop("_n")
        return mine.groupBy(by, "salt").cogroup(asked.groupBy(by, "salt"))

    listed = f"array<struct<distance: double, ids: array<{id_type}>>>"
    empty = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("pid", "found", "looked", "full", "v", "radius", "away")})

    def own_block(key: tuple, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or mine.empty:
            return empty
        found, radius, full = _lists(asked, mine, known.value, None, extra)
        away = [reach[reach != int(key[0])] for reach in known.value.reached(np.stack(asked["v"]), radius)]
        share = np.r_[full, np.zeros(len(asked) - 1, np.int64)]
        return pd.DataFrame({"pid": asked["pid"], "found": found, "looked": len(mine), "full": share, "v": asked["v"], "radius": radius, "away": away})

    near = dealt(q, t, "block", QUERIES_PER_TASK).applyInPandas(own_block, f"pid long, found {listed}, looked long, full long, v array<double>, radius double, away array<int>")
    near = cut_lineage(near, "vectors-near")

    def by_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a query and group that it has to ask, with the blocks in question."""
        for b in batches:
            many = b["away"].str.len().to_numpy(np.int64)
            row, block = np.repeat(np.arange(len(b)), many), np.concatenate([*b["away"], np.empty(0, np.int64)]).astype(np.int64)
            group = known.value.group[block]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])][: len(row)])  # blocks are in order
            cut = b.iloc[row[begin]]
            yield pd.DataFrame({"pid": cut["pid"], "v": cut["v"], "radius": cut["radius"], "group": group[begin], "blocks": np.array([*np.split(block, begin[1:]), None], dtype=object)[: len(begin)]})

    asked = near.select("pid", "v", "radius", "away").where(F.size("away") > 0).mapInPandas(by_group, "pid long, v array<double>, radius double, group long, blocks array<int>")
    of_block = F.get(F.array(*[F.lit(int(g)) for g in cells.group]), F.col("block")).cast("long")

    def other_blocks(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or mine.empty:
            return empty[["pid", "found", "looked", "full"]]
        limit = asked["radius"].to_numpy(float)
        many = asked["blocks"].str.len().to_numpy(np.int64)
        row, wanted = np.repeat(np.arange(len(asked)), many), np.concatenate(asked["blocks"].to_list())
        found, looked, share = [[] for _ in range(len(asked))], np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for block, part in mine.groupby("block"):
            to = row[wanted == block]
            for at in (to[i : i + QUERIES_PER_TASK] for i in range(0, len(to), QUERIES_PER_TASK)):
                lists, radius, full = _lists(asked.iloc[at][["v"]], part, known.value, limit[at], extra)
                looked[at] += len(part)
                share[at[0]] += full
                limit[at] = np.minimum(limit[at], radius)  # this block alone holds k within that
                for i, new in zip(at.tolist(), lists):
                    found[i] = sorted(found[i] + new, key=lambda e: (e["distance"], e["ids"][0]))[:extra] if found[i] else new
        return pd.DataFrame({"pid": asked["pid"], "found": found, "looked": looked, "full": share})

    lists = near.select("pid", "found", "looked", "full")
    if cells.blocks.sum() > 1:
        grouped = dealt(asked, t.withColumn("group", of_block), "group", max(QUERIES_PER_TASK, LIST_ENTRIES // extra))
        lists = lists.unionByName(grouped.applyInPandas(other_blocks, f"pid long, found {listed}, looked long, full long"))
    if work:
        return lists.agg(F.lit(n * places.count()).alias("all_pairs"), F.sum("looked").alias("looked_at"), F.sum("full").alias("in_full"))
    flat = F.flatten(F.transform("f", lambda s: F.transform(s["ids"], lambda i: F.struct(s["distance"].alias("distance"), i.alias("id")))))
    best = lists.groupBy("pid").agg(F.flatten(F.collect_list("found")).alias("f")).select("pid", F.slice(F.array_sort(flat), 1, extra).alias("best"))
    out = queries.join(places.join(best, "pid").drop("pid"), "v")
    mine = F.filter("best", lambda s: s["id"] != F.col("id")) if exclude_self else F.col("best")
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(mine, 1, k)).alias("rank", "b"))
    return out.select("query_id", F.col("b.id").alias("neighbor_id"), F.col("b.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
