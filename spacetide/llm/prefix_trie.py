"""Trie of conversation prefixes from composable fingerprints.

A turn is an affine map over four prime fields, a run of turns the product of its maps. Products of stored conversations come
from one distributed scan; the product of a rebuilt conversation (head of a base, then its own rest) is put together from two of them
by ``P(rest) + (P(base head) - P(own head)) * B^k``, so rebuilt texts exist nowhere. Prefixes with one product are a node. Whether they
are equal is not left to the hash: turns of a node that are stored at different places are read again and
compared as texts, and any difference starts over with the next seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_path, scratch_path

#: The fields (largest primes below 2^31) and how many ids a piece of an end list holds.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
PIECE = 1 << 16
#: Seeds tried before giving up; one suffices unless two different prefixes share 124 bits.
SEEDS = 4
_LOW = np.uint64((1 << 31) - 1)
_KEY = ["depth", "f1", "f2"]
Rule = Callable[[Column], Column]


def _bases(seed: int) -> np.ndarray:
    draw = hashlib.sha256(f"prefix trie {seed}".encode()).digest()
    return np.frombuffer(draw[:32], "<u8") % (PRIMES - np.uint64(1 << 20)) + np.uint64(1 << 19)


def _powers(base: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` in every field: a row per field."""
    out = np.ones((4, len(exponents)), np.uint64)
    square, left, p = base[:, None].copy(), exponents.astype(np.uint64), PRIMES[:, None]
    while left.any():
        out = np.where(left & np.uint64(1), out * square % p, out)
        square, left = square * square % p, left >> np.uint64(1)
    return out


def _unpack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    return np.stack([a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW])


def _pack(x: np.ndarray) -> list[np.ndarray]:
    return [(x[i] << np.uint64(31) | x[i + 1]).view(np.int64) for i in (0, 2)]


def _elements(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A turn's number in every field from the two hashes of its content."""
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    return np.stack([h1 >> np.uint64(33), h1 & _LOW, h2 >> np.uint64(33), h2 & _LOW]) % PRIMES[:, None]


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _hashes(role: Column, text: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), role, text).alias(f"h{k + 1}") for k in (0, 1)]


def _scan(base: np.ndarray):
    """Place and product of every row within its conversation, as far as this partition knows; a last row tells where it stopped."""
    inverse = np.array([pow(int(b), -1, int(p)) for b, p in zip(base, PRIMES)], np.uint64)
    p = PRIMES[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = conv = None
        seen, product = 0, np.zeros((4, 1), np.uint64)
        names = ["conv", "pos", "f1", "f2", "h1", "h2", "size", "part", "first"]
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, h1, h2, size = _columns(batch, "conv", "h1", "h2", "size")
            first = int(convs[0]) if first is None else first
            n = len(convs)
            starts = np.r_[True, convs[1:] != convs[:-1]]
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            pos = np.arange(n) - begin + 1
            up = np.arange(1, n + 1)
            sums = np.c_[np.zeros((4, 1), np.uint64), np.cumsum(_elements(h1, h2) * _powers(inverse, up) % p, axis=1, dtype=np.uint64) % p]
            local = (sums[:, 1:] + p - sums[:, begin]) % p * _powers(base, up) % p
            if conv == convs[0]:
                head = np.flatnonzero(begin == 0)
                local[:, head] = (local[:, head] + product * _powers(base, pos[head])) % p
                pos[head] += seen
            conv, seen, product = int(convs[-1]), int(pos[-1]), local[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (convs, pos, *_pack(local), h1, h2, size, np.full(n, part))] + [pa.nulls(n, pa.int64())], names=names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (conv, seen, *[v[0] for v in _pack(product)], 0, 0, 0, part, first)], names=names)

    return run


def _carries(ends: list, base: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """What each partition's first conversation had in the partitions before: conversation, turns, product. A row a partition."""
    out, conv, n, product = {}, None, 0, [0] * 4
    for row in sorted(ends, key=lambda r: r["part"]):
        own = [int(x[0]) for x in _unpack(np.array([row["f1"]]), np.array([row["f2"]]))]
        if row["first"] == conv:
            out[row["part"]] = (conv, n, product)
            if row["conv"] == conv:
                own = [(v * pow(int(b), row["pos"], int(p)) + o) % int(p) for v, b, o, p in zip(product, base, own, PRIMES)]
                n += row["pos"]
                product = own
                continue
        conv, n, product = row["conv"], row["pos"], own
    return out


def _placed(spark: SparkSession, coded: DataFrame, base: np.ndarray) -> tuple[DataFrame, list[str]]:
    """``(conv, pos, f1, f2, h1, h2, size)``: every stored turn with its place and the product up to it; and the folders to drop later.

    One sort over all turns, dealt by ranges of (conversation, turn), so a conversation of any length spreads over many tasks.
    """
    order = ["conv", F.asc_nulls_first("turn"), "h1", "h2", "salt"]
    dealt = coded.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv long, pos long, f1 long, f2 long, h1 long, h2 long, size long, part long, first long"
    paths = [scratch_path(spark, "turns"), scratch_path(spark, "placed")]
    dealt.select("conv", "h1", "h2", "size").mapInArrow(_scan(base), schema).write.parquet(paths[0])
    stage = spark.read.schema(schema).parquet(paths[0])
    carries = _carries(stage.filter("first IS NOT NULL").collect(), base)  # a row a partition

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = PRIMES[:, None]
        for batch in batches:
            convs, pos, f1, f2, h1, h2, size, part = _columns(batch, "conv", "pos", "f1", "f2", "h1", "h2", "size", "part")
            pos, f1, f2 = pos.copy(), f1.copy(), f2.copy()
            for k in np.unique(part).tolist():
                if k in carries:
                    conv, n, product = carries[k]
                    own = np.flatnonzero((part == k) & (convs == conv))
                    moved = (_unpack(f1[own], f2[own]) + np.array(product, np.uint64)[:, None] * _powers(base, pos[own])) % p
                    f1[own], f2[own] = _pack(moved)
                    pos[own] += n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (convs, pos, f1, f2, h1, h2, size)], names=batch.schema.names[:7])

    short = schema.removesuffix(", part long, first long")
    stage.filter("first IS NULL").drop("first").mapInArrow(fix, short).write.parquet(paths[1])
    return spark.read.schema(short).parquet(paths[1]), paths


def _rebuilt(base: np.ndarray):
    """Products of rebuilt prefixes and of the prefixes one turn shorter: ``f + (to - from) * B^k`` and ``(that - turn) / B``."""
    inverse = np.array([pow(int(b), -1, int(p)) for b, p in zip(base, PRIMES)], np.uint64)[:, None]
    p = PRIMES[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1, f2, t1, t2, o1, o2, k, h1, h2 = _columns(batch, "f1", "f2", "t1", "t2", "o1", "o2", "k", "h1", "h2")
            shift = (_unpack(t1, t2) + p - _unpack(o1, o2)) % p * _powers(base, k) % p
            made = (_unpack(f1, f2) + shift) % p
            up = (made + p - _elements(h1, h2)) % p * inverse % p
            stay = [batch.column(n) for n in ("conv", "depth", "h1", "h2", "size", "at", "place", "ends")]
            yield pa.RecordBatch.from_arrays([*stay, *[pa.array(x) for x in (*_pack(made), *_pack(up))]], names=["conv", "depth", "h1", "h2", "size", "at", "place", "ends", "f1", "f2", "p1", "p2"])

    return run


def _members(placed: DataFrame, rule: Rule, head: Rule, most: int, base: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and ``(conv, turns)`` of the rebuilt conversations."""
    first = F.when(F.col("pos") <= most, F.struct("pos", "f1", "f2", "h1", "h2", "size"))
    convs = placed.groupBy("conv").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("heads"))
    convs = convs.withColumns({"base": rule(F.col("conv")), "h": F.greatest(F.lit(0), F.least(F.lit(most), head(F.col("conv")))).cast("long")})
    bases = convs.select(F.col("conv").alias("base"), F.col("heads").alias("source"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce(F.size("source"), F.lit(0))).cast("long"))
    convs = convs.withColumn("turns", F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    zero = F.lit(0).cast("long")

    def product(heads: str, n: str, f: str) -> Column:
        return F.when(F.col(n) == 0, zero).otherwise(F.try_element_at(F.col(heads), F.col(n).cast("int"))[f])

    lent = convs.select("conv", "base", "turns", F.explode(F.slice("source", 1, F.col("lent").cast("int"))).alias("t")).select(
        "conv", F.col("t.pos").alias("depth"), "t.h1", "t.h2", "t.size", F.col("base").alias("at"), F.col("t.pos").alias("place"), (F.col("t.pos") == F.col("turns")).alias("ends"),
        "t.f1", "t.f2", *[zero.alias(c) for c in ("t1", "t2", "o1", "o2", "k")])
    own = placed.join(
        convs.filter("n > h").select("conv", "h", "lent", "turns", product("source", "lent", "f1").alias("t1"), product("source", "lent", "f2").alias("t2"), product("heads", "h", "f1").alias("o1"), product("heads", "h", "f2").alias("o2")), "conv"
    ).filter("pos > h").select(
        "conv", (F.col("lent") + F.col("pos") - F.col("h")).alias("depth"), "h1", "h2", "size", F.col("conv").alias("at"), F.col("pos").alias("place"), (F.col("lent") + F.col("pos") - F.col("h") == F.col("turns")).alias("ends"),
        "f1", "f2", "t1", "t2", "o1", "o2", (F.col("pos") - F.col("h")).alias("k"))
    schema = "conv long, depth long, h1 long, h2 long, size long, at long, place long, ends boolean, f1 long, f2 long, p1 long, p2 long"
    return lent.union(own).mapInArrow(_rebuilt(base), schema), convs.select("conv", "turns")


def _differ(turns: DataFrame, nodes: DataFrame, seed: int) -> bool:
    """Whether any node holds two different turns: by their hashes, or, where they are stored at several places, by their texts."""
    if nodes.filter("low <> high").limit(1).count():
        return True
    texts = turns.select("conv", "role", "text", *_hashes(F.col("role"), F.col("text"), seed))
    several = cut_lineage(nodes.filter("first_place <> last_place").select(F.col("low.h1").alias("h1"), F.col("low.h2").alias("h2")).distinct(), "several")  # its size decides how texts find it
    pair = F.struct("role", "text")
    held = texts.join(several, ["h1", "h2"], "left_semi").groupBy("h1", "h2", F.pmod("conv", F.lit(997)).alias("salt")).agg(F.min(pair).alias("low"), F.max(pair).alias("high"))
    return held.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").limit(1).count() > 0


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order, comma-joined.

    Ids are dealt by ranges of (node, id) and joined to pieces there; only pieces meet in a task, which takes them one by one.
    """
    order = [*_KEY, "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def close() -> pa.RecordBatch:
            row = [*key, ids[0], ",".join(map(str, ids))]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[*order, "ids"])

        for batch in batches:
            for *own, conv in zip(*[batch.column(c).to_pylist() for c in order]):
                if ids and (own != key or len(ids) == PIECE):
                    yield close()
                    ids = []
                key = own
                ids.append(conv)
        if ids:
            yield close()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*_KEY, "ends_sha256"]
        for batch in batches:
            rows = []
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
                if own != key:
                    if key is not None:
                        rows.append([*key, state.hexdigest()])
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b",")
                    state.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=names)

    keys = "depth long, f1 long, f2 long"
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{keys}, conv long, ids string")
    return dealt.repartition(*_KEY).sortWithinPartitions(*order).drop("conv").mapInArrow(hashes, f"{keys}, ends_sha256 string")


def _subtrees(nodes: DataFrame, deepest: int) -> DataFrame:
    """``(conv, depth, n_leaves, saved)`` summed over subtrees by doubling: after a round every node knows twice as many levels below it.

    ``nodes``: ``(conv, depth, up, n_leaves, saved)`` at depth 1 or more; up: the ancestor's conversation. Rounds grow with the logarithm of the
    depth; each is written to the shared folder and the one before is deleted.
    """
    spark, step, path = nodes.sparkSession, 1, None
    while step < deepest:
        below = nodes.filter(F.col("depth") > step).groupBy(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = nodes.join(below, ["conv", "depth"], "left").select("conv", "depth", "up", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        over = nodes.filter(F.col("depth") > step).select(F.col("conv").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        far = F.col("depth") > 2 * step
        near = summed.filter(~far).withColumn("up", F.lit(None).cast("long"))
        new = summed.filter(far).join(over, ["up", "depth"]).select("conv", "depth", F.col("next").alias("up"), "n_leaves", "saved").union(near)
        new_path = scratch_path(spark, "subtrees")
        new.write.parquet(new_path)
        if path:
            drop_path(spark, path)
        nodes, path, step = spark.read.schema(new.schema).parquet(new_path), new_path, 2 * step
    return nodes


def prefix_trie(turns: DataFrame, base: Rule, head: Rule, most: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Conversation c is rebuilt from the first ``head(c)`` turns (``most`` at most) of conversation ``base(c)`` and its own turns after as
    many; base and head are column functions of the id. A node is named by the smallest conversation that starts with it and its depth.

    Turns are in order of ``turn``, null first; rows of one conversation and turn follow each other in order of the hash of their content,
    repeated rows are repeated turns. Null roles and texts are empty; rows without a conversation id belong to none and are left out.
    A conversation may be of any length and a text as long as Spark's strings. An empty table has no node, any other one a root.
    Other columns are not looked at.
    """
    spark = turns.sparkSession
    turns = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).filter("conv IS NOT NULL")
    for seed in range(SEEDS):
        bases = _bases(seed)
        coded = turns.select("conv", "turn", *_hashes(F.col("role"), F.col("text"), seed), F.octet_length("text").cast("long").alias("size"))
        placed, paths = _placed(spark, coded, bases)
        members, convs = _members(placed, base, head, most, bases)
        content, place = F.struct("h1", "h2"), F.struct("at", "place")
        grouped = members.groupBy(*_KEY).agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("size").alias("size"),
            F.min(content).alias("low"), F.max(content).alias("high"), F.min(place).alias("first_place"), F.max(place).alias("last_place"))
        paths += [scratch_path(spark, name) for name in ("nodes", "ends")]
        grouped.write.parquet(paths[2])
        nodes = spark.read.schema(grouped.schema).parquet(paths[2])
        if not _differ(turns, nodes, seed):
            break
        for path in paths:
            drop_path(spark, path)
    else:
        raise RuntimeError(f"different prefixes share fingerprints under {SEEDS} seeds")
    turnless = convs.filter("turns = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f) for f in ("f1", "f2")], "conv")
    ended = _end_hashes(members.filter("ends").select(*_KEY, "conv").union(turnless))
    ended.write.parquet(paths[3])
    ended = spark.read.schema(ended.schema).parquet(paths[3])

    whole = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    least = F.lit(whole["least"]).cast("long")
    names = nodes.select(F.col("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(names.withColumn("depth", F.col("depth") + 1), ["depth", "p1", "p2"])
    shape = [*_KEY, "conv", "n_convs", "size", "parent_conv_id"]
    tree = deep.select(*shape).union(nodes.filter("depth = 1").withColumn("parent_conv_id", least).select(*shape))
    paths.append(scratch_path(spark, "tree"))
    tree.write.parquet(paths[4])
    tree = spark.read.schema(tree.schema).parquet(paths[4])
    for path in paths[:3]:
        drop_path(spark, path)
    children = tree.filter("depth > 1").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = tree.join(children, ["conv", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size"), "up": F.when(F.col("depth") > 1, F.col("parent_conv_id"))})
    known = known.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    paths.append(scratch_path(spark, "known"))
    known.write.parquet(paths[5])
    known = spark.read.schema(known.schema).parquet(paths[5])
    drop_path(spark, paths[4])
    total = known.agg(F.max("depth").alias("deepest"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.sum((F.col("depth") == 1).cast("long")).alias("n_children")).first()
    sums = _subtrees(known.select("conv", "depth", "up", "n_leaves", "saved"), total["deepest"] or 0)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = known.drop("n_leaves", "saved").join(sums.drop("up"), ["conv", "depth"]).join(ended, _KEY, "left")
    shape = [F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")]
    top = [(whole["least"], 0, None, whole["n"], total["n_children"] or 0, total["n_leaves"] or 1, total["saved"] or 0)] if whole["n"] else []
    root = spark.createDataFrame(top, "conv long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long")
    root = root.join(ended.filter("depth = 0").select("depth", "ends_sha256"), "depth", "left")
    return found.select(*shape).union(root.select(*shape))
