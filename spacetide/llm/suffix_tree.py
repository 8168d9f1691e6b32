"""Language-model scores from a probabilistic suffix tree over words, beside a word-count baseline.

Tokens are the words of a text, A-Z lower-cased, and an end mark. All training texts are counted. Contexts of one to DEPTH
words are found level by level: a run of words is a context if it occurs CONTEXT times or more, and what follows it counts if
it follows LEAST times or more, both at any size of the corpus. A context is retained if its next-word distribution diverges from that of the context without its oldest word, weighted by its count. Distributions
are smoothed towards that shorter context, which also covers the next words that were not counted. A token is scored in the
state of the longest retained context before it.

Runs are known by 64-bit hashes and held in tables, level by level. A text's score is a sum over its runs, each of which adds what it
changes against the run without its oldest word, so texts and runs meet in one join. Only the HOT most frequent runs, which
would be hot keys of that join, are sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_path, scratch_path
from .text import map_texts, raw_texts, steps

#: Longest context in words, most runs whose values go to the tasks (16 bytes each), least divergence in nats, weight of the shorter context.
DEPTH, HOT, DIVERGENCE, PRIOR = 3, 1 << 17, 10.0, 16.0
#: Least count of a run in its context, and of a context.
LEAST, CONTEXT = 2, 8
#: Tokens for each bucket of the run tables, at least.
BUCKET = 1 << 22
#: Words of at most so many bytes, the most frequent so many, whose counts are sent to the tasks; all others are joined.
HEAD_BYTES, HEAD_WORDS = 128, 100_000
#: Entries a task gathers before it passes them on; text bytes it splits into words at once.
FLUSH, STEP = 1 << 18, 1 << 20
#: Runs a task gathers before it passes them on; words whose hashes a worker keeps; most 64-bit words of a filter (a full one only lets more through).
RUNS, HASHES, FILTER = 1 << 22, 500_000, 1 << 24
#: Keys joined at once, which fit the processor's cache.
CHUNK = 1 << 14
#: Words in a piece of a filter (their places take two bytes), and pieces that the driver takes at once.
PIECE, PIECES = 1 << 16, 16
#: Words have no white space, so these marks are none.
_START, _END = b"\t", b"\n"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words and marks of the texts in column 0, combined within the task."""

    def out(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    words: Counter = Counter()
    for part in chain.from_iterable(steps(b, 0, STEP) for b in batches):
        for raw in raw_texts(part.column(0)):
            words.update(raw.lower().split())
        words[_END] += part.num_rows
        if len(words) > FLUSH:
            yield out(words)
            words = Counter()
    if words:
        yield out(words)


def _numbers(texts: list[bytes], number: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words and marks of each text, all their numbers in a row (-1: none), and where texts begin in it."""
    rows = [[_START, *raw.lower().split(), _END] for raw in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    return rows, np.fromiter((number.get(w, -1) for r in rows for w in r), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted code in sorted ``codes``, -1 where it is not there."""
    if not len(codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


class _Hashes(dict):
    """Word -> its hash, as Spark's ``xxhash64`` has it; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHES:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def _join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of runs by those of the runs without their last and without their first word: Spark's ``xxhash64(a, b)``."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    whole = np.empty(len(a), np.uint64)
    for i in range(0, len(a), CHUNK):
        out = np.full(len(a[i : i + CHUNK]), 42, np.uint64)
        for x in (a[i : i + CHUNK], b[i : i + CHUNK]):
            out = out + five + np.uint64(8)
            out ^= turn(x * two, 31) * one
            out = turn(out, 27) * one + four
        out = (out ^ out >> np.uint64(33)) * two
        out = (out ^ out >> np.uint64(29)) * three
        whole[i : i + CHUNK] = out ^ out >> np.uint64(32)
    return whole


def _keys(rows: list[list[bytes]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and mark, and its place in its text."""
    sizes = np.array([len(r) for r in rows], np.int64)
    n = int(sizes.sum())
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(rows)), np.uint64, n), np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bits(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a filter of ``width`` words (a power of two) and the bits in it, by key."""
    one = np.uint64(1)
    return (keys >> np.uint64(65 - width.bit_length())).astype(np.int64), one << (keys & np.uint64(63)) | one << (keys >> np.uint64(6) & np.uint64(63))


def _passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    at, bits = _bits(keys, len(filter_))
    return filter_[at] & bits == bits


def _filter(keys: DataFrame, width: int) -> np.ndarray:
    """Filter over the longs in the first column. Tasks write their words of each PIECE of it, and the driver takes a few pieces at a time."""
    spark = keys.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        if found:
            at, bits = _bits(np.sort(np.concatenate(found)), width)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)]
            if len(at):
                at, bits = at[first], np.bitwise_or.reduceat(bits, first)
                cut = np.searchsorted(at, np.arange(0, width + PIECE, PIECE)).tolist()
                for i in (i for i in range(len(cut) - 1) if cut[i + 1] > cut[i]):
                    held = [(x[cut[i] : cut[i + 1]] - y).astype(kind).tobytes() for x, y, kind in ((at, i * PIECE, "<u2"), (bits, np.uint64(0), "<u8"))]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x], pa.binary()) for x in held]], names=["piece", "at", "bits"])

    path = scratch_path(spark, "filter")
    keys.mapInArrow(run, "piece int, at binary, bits binary").write.parquet(path)
    pieces = spark.read.schema("piece int, at binary, bits binary").parquet(path)
    out = np.zeros(width, np.uint64)
    for i in range(0, -(-width // PIECE), PIECES):
        got = pieces.filter(F.col("piece").between(i, i + PIECES - 1)).toArrow()
        for batch in got.to_batches():
            for piece, at, bits in zip(*(c.to_pylist() for c in batch.columns)):
                out[piece * PIECE + np.frombuffer(at, "<u2").astype(np.int64)] |= np.frombuffer(bits, "<u8")  # no place twice in a row
    drop_path(spark, path)
    return out


def _floor(counts: DataFrame, most: int) -> int:
    """Least n of the column ``n`` that at most ``most`` rows exceed, 0 if there are no more. Distinct counts are few, as their sum is bounded by the tokens."""
    got = counts.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    n, rows = got["n"].to_numpy(), got["rows"].to_numpy()
    order = np.argsort(-n)
    over = np.flatnonzero(np.cumsum(rows[order]) > most)
    return int(n[order][over[0]]) if len(over) else 0


def _filled(parts: Iterator[tuple[np.ndarray, ...]], kinds: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of the parts one behind the other, RUNS of them at a time; the next ones take the place of the last."""
    held, size = [np.empty(RUNS, kind) for kind in kinds], 0
    for part in parts:
        at = 0
        while at < len(part[0]):
            n = min(RUNS - size, len(part[0]) - at)
            for into, x in zip(held, part):
                into[size : size + n] = x[at : at + n]
            size, at = size + n, at + n
            if size == RUNS:
                yield tuple(held)
                size = 0
    if size:
        yield tuple(x[:size] for x in held)


def _dealt(key: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Columns of sorted keys as one row a bucket: equal keys have equal buckets, and a bucket is a range of keys."""
    cut = np.r_[np.searchsorted(key, np.array([-(-(i << 32) // parts) << 32 for i in range(parts)], np.uint64)), len(key)]
    full = np.flatnonzero(np.diff(cut))
    ends = np.r_[cut[full], len(key)]
    blobs = []
    for c in columns:
        c = np.ascontiguousarray(c)
        blobs.append(pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c)]))
    for i in range(0, len(full), 64):
        yield pa.RecordBatch.from_arrays([pa.array(full[i : i + 64], pa.int32()), *[b[i : i + 64] for b in blobs]], names=["bucket", *[f"c{k}" for k in range(len(blobs))]])


def _sums(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sum of each one's ``n`` (without it, how often it is there)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    if n is None:
        return key[first], order[first], np.diff(np.r_[first, len(key)])
    return key[first], order[first], np.add.reduceat(n[order], first) if len(key) else n


def _runs(train: DataFrame, text: str, order: int, contexts, parts: int) -> DataFrame:
    """``(key, prefix, suffix, n)`` of all runs of ``order`` words that occur LEAST times; ``contexts``: filter over the runs of a word
    less that occur CONTEXT times, which have to come first (what else it lets through is dropped by a join later)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashes = _Hashes()
        for part in chain.from_iterable(steps(b, 0, STEP) for b in batches):
            rows = [[_START, *raw.lower().split(), _END] for raw in raw_texts(part.column(0))]
            key, place = _keys(rows, hashes)
            for _ in range(order - 2):
                key = np.r_[np.uint64(0), _join_keys(key[:-1], key[1:])]
            at = np.flatnonzero((place >= order - 1) & np.r_[False, _passes(contexts.value, key[:-1])])
            yield key[at - 1], key[at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, after in _filled(pairs(batches), ("<u8", "<u8")):
            key, place, n = _sums(_join_keys(before, after))
            yield from _dealt(key, [before[place], after[place], n.astype("<u4")], parts)  # the key follows from the two

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, *blobs in zip(*[c.to_pylist() for c in b.columns]):
                held.setdefault(bucket, []).append(blobs)
        for bucket in sorted(held):
            before, after, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held.pop(bucket)), ("<u8", "<u8", "<u4")))
            key, place, n = _sums(_join_keys(before, after), n.astype(np.int64))
            often = n >= LEAST
            place = place[often]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key[often], before[place], after[place], n[often])], names=["key", "prefix", "suffix", "n"])

    counted = train.select(text).mapInArrow(count, "bucket int, c0 binary, c1 binary, c2 binary")
    return counted.repartition(parts, "bucket").mapInArrow(add, "key long, prefix long, suffix long, n long")


def _level(runs: DataFrame, below: DataFrame, into: str) -> None:
    """Write to ``into`` ``(key, n, of, prefix, q, p, back)`` of ``runs``: count, context's count and key, probability in the shorter context and in its
    own; back: log10 of what its context leaves for other words against the shorter one, null if that is not retained.
    ``below``: ``(key, n, p)`` of all runs of a word less."""
    before = below.filter(F.col("n") >= CONTEXT).select(F.col("key").alias("prefix"), F.col("n").alias("of"))
    after = below.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
    path = scratch_path(runs.sparkSession, "runs-in-context")
    runs.join(before, "prefix").join(after, "suffix").drop("suffix").write.parquet(path)
    placed = runs.sparkSession.read.parquet(path)
    n, of, q = (F.col(c).cast("double") for c in ("n", "of", "q"))
    rest_n, rest_q = F.greatest(F.max("of") - F.sum("n"), F.lit(0)), F.greatest(1 - F.sum("q"), F.lit(1e-9))
    contexts = placed.groupBy("prefix").agg(F.max("of").alias("of_"), rest_n.alias("rest_n"), rest_q.alias("rest_q"), F.sum(n * F.log(n / of / q)).alias("seen"))
    rest = F.when(F.col("rest_n") > 0, F.col("rest_n") * F.log(F.col("rest_n") / F.col("of_") / F.col("rest_q"))).otherwise(0.0)
    back = F.log10((F.col("rest_n") + PRIOR * F.col("rest_q")) / (F.col("of_") + PRIOR) / F.col("rest_q"))
    kept = contexts.filter(F.col("seen") + rest >= DIVERGENCE).select("prefix", back.alias("back"))
    own = F.when(F.col("back").isNull(), q).otherwise((n + PRIOR * q) / (of + PRIOR))
    placed.join(kept, "prefix", "left").select("key", "n", "of", "prefix", "q", own.alias("p"), "back").write.parquet(into)
    drop_path(runs.sparkSession, path)


def _tree(train: DataFrame, text: str, words: DataFrame, n_texts: int, discount: float, total: int, parts: int) -> DataFrame:
    """``(run_order, key, n, value)``: what each occurrence of a run adds to the log10 probability of a text, beside the words' own. A key may
    have two rows, as a run that ends in its context's next word and as a context."""
    spark = train.sparkSession
    width = min(FILTER, 1 << max(10, (total // 64).bit_length()))
    p = F.greatest(F.col("n") - discount, F.lit(1e-9)) / max(total, 1)
    start = spark.range(1).select(F.xxhash64(F.lit(bytes(_START))).alias("key"), F.lit(n_texts).cast("long").alias("n"), F.lit(1.0).alias("p"))
    below = words.filter(F.col("n") >= LEAST).select(F.xxhash64("word").alias("key"), "n", p.alias("p")).union(start)
    path, stages = scratch_path(spark, "values"), []
    contexts = spark.sparkContext.broadcast(_filter(below.filter(F.col("n") >= CONTEXT).select("key"), width))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * parts, 32).cast("int")
    for order in range(2, DEPTH + 2):
        stages.append(scratch_path(spark, "runs"))
        _runs(train, text, order, contexts, parts).write.parquet(stages[-1])
        runs = spark.read.parquet(stages[-1])
        contexts.destroy()
        if order <= DEPTH:
            contexts = spark.sparkContext.broadcast(_filter(runs.filter(F.col("n") >= CONTEXT).select("key"), width))
        stages.append(scratch_path(spark, "level"))
        _level(runs, below, stages[-1])
        level = spark.read.parquet(stages[-1])
        for stage in stages[:-1]:
            drop_path(spark, stage)
        stages = stages[-1:]
        held = level.filter(F.col("back").isNotNull())
        gain = held.select(F.lit(order).alias("run_order"), "key", "n", (F.log10("p") - F.log10("q") - F.col("back")).alias("value"))
        context = held.groupBy("prefix").agg(F.max("of").alias("n"), F.max("back").alias("value")).select(F.lit(order - 1).alias("run_order"), F.col("prefix").alias("key"), "n", "value")
        values = gain.union(context).withColumn("bucket", bucket)
        values.repartition(parts, "bucket").write.mode("append").parquet(path)
        below = level.select("key", "n", "p")
    drop_path(spark, stages[-1])
    return spark.read.schema(values.schema).parquet(path)


def _looked_up(asked: DataFrame, values: DataFrame, parts: int) -> DataFrame:
    """``(row, tree)``: sum of the values of the keys in the binary column 1 of ``asked``; rows without any are left out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for row, blob in zip(b.column(0).to_pylist(), b.column(1)):
                key = np.frombuffer(blob.as_buffer(), "<u8")
                yield np.broadcast_to(np.int64(row), len(key)), key

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, key in _filled(keys(batches), ("<i8", "<u8")):
            high = row >> 31
            cut = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(row)]
            for i, j in zip(cut, cut[1:]):
                order = np.argsort(key[i:j])
                for b in _dealt(key[i:j][order], [key[i:j][order], (row[i:j] & (1 << 31) - 1).astype("<u4")[order]], parts):
                    yield b.append_column("base", pa.array(np.full(b.num_rows, int(high[i]) << 31)))

    def find(asked: pa.Table, known: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(asked["c0"].to_pylist()), "<u8")
        row = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, "<u4") + np.int64(base) for x, base in zip(asked["c1"].to_pylist(), asked["base"].to_pylist())]])
        codes, _, value = _sums(known["key"].to_numpy().view(np.uint64), known["value"].to_numpy())
        at = _find(codes, key)
        key, row = value[at[at >= 0]], row[at >= 0]
        rows, at = np.unique(row, return_inverse=True)
        return pa.table({"row": pa.array(rows, pa.int64()), "tree": pa.array(np.bincount(at, key, len(rows)), pa.float64())})

    dealt = asked.mapInArrow(deal, "bucket int, c0 binary, c1 binary, base long")
    parts_ = dealt.groupBy("bucket").cogroup(values.select("bucket", "key", "value").groupBy("bucket")).applyInArrow(find, "row long, tree double")
    return parts_.groupBy("row").agg(F.sum("tree").alias("tree"))


def scored(docs: DataFrame, train: DataFrame, text: str = "text", train_text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` plus n_tokens, n_known, train_tokens, base_score and score, learnt from all texts of ``train``.

    Null and empty texts have one token, the end. Repeated rows are scored alike. With no training text every word is
    unknown, and unknown words have probability 1. ``score`` is the tree's log10 probability of the tokens.

    Counts of the most frequent words go to the tasks (HEAD_WORDS of at most HEAD_BYTES each), and so do the HOT most frequent runs; a text's
    other words and runs are joined with the tables of all words and runs.
    """
    spark = docs.sparkSession
    words = train.select(train_text).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words, "word-counts")
    total, kinds, once, n_texts = (x or 0 for x in words.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.max(F.when(F.col("word") == F.lit(_END), F.col("n")))).first())
    short = words.filter((F.length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(_END)))
    edge = _floor(short, HEAD_WORDS)  # all shorter words above it are in the head
    head = short.filter(F.col("n") > edge).select("word", "n").toArrow()
    number = {_START: 0, _END: 1} | {w: i for i, w in enumerate(head["word"].to_pylist(), 2)}
    counts = np.r_[n_texts, n_texts, head["n"].to_numpy()].astype(np.int64)
    number_ = spark.sparkContext.broadcast(number)
    # an unknown word is one event, as in the baseline; it gets what a constant discount takes from all counts
    discount = min(0.9, max(once, 1) / kinds) if kinds else 0.0
    unknown = discount * kinds / total if total else 1.0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    values = _tree(train, train_text, words, n_texts, discount, total, parts)
    floor = _floor(values.filter("run_order > 1 OR n >= " + str(max(edge, 1))), HOT)
    most = F.when(F.col("run_order") == 1, F.col("n") >= max(edge, 1)).otherwise(F.col("n") > floor)
    hot = values.filter(most).select("key", "value").toArrow()
    hot_keys, _, hot_values = _sums(hot["key"].to_numpy().view(np.uint64), hot["value"].to_numpy())
    at = _find(hot_keys, np.array([xxhash.xxh64_intdigest(w, 42) for w in number], np.uint64))
    backs = np.where(at >= 0, hot_values[at], 0.0) if len(hot_keys) else np.zeros(len(number))
    filter_ = _filter(values.select("key"), min(FILTER, 1 << max(10, (values.count() // 4).bit_length())))  # 16 bits a key at least
    root = np.log10(np.maximum(counts - discount, 1e-9) / max(total, 1))
    model = spark.sparkContext.broadcast((root, np.log10(counts + 1.0), backs, filter_, hot_keys, hot_values))
    list_kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
    fields = [("own_tokens", "bigint", pa.int64()), ("own_known", "bigint", pa.int64()), ("own_logs", "double", pa.float64()), ("own_rest", "array<struct<word:binary,k:bigint>>", list_kind), ("own_score", "double", pa.float64()), ("own_runs", "binary", pa.binary())]

    def make():
        hashes = _Hashes()

        def run(texts: list[bytes]) -> list:
            root, logs, backs, filter_, hot_keys, hot_values = model.value
            rows, word, firsts = _numbers(texts, number_.value)
            token = np.ones(len(word), bool)
            token[firsts] = False  # the start mark is a context, no token
            if not total:
                token_known = np.zeros(len(word), bool)
            else:
                token_known = token & (word >= 0)
            by_text = lambda x: np.add.reduceat(np.where(token, x, 0), firsts)
            rest = []
            for row, first in zip(rows, firsts):
                out = np.flatnonzero(word[first : first + len(row)] < 0)
                rest.append([{"word": w, "k": k} for w, k in Counter(row[i] for i in out).items()])
            base = np.where(token_known, logs[word], 0.0)
            scores = np.where(token & (word >= 0), root[word], 0.0) if total else np.zeros(len(word))
            scores += np.where(word >= 0, backs[word], 0.0)
            key, place = _keys(rows, hashes)
            asked = []
            for order in range(1, DEPTH + 2):
                if order > 1:
                    key = np.r_[np.uint64(0), _join_keys(key[:-1], key[1:])]
                at = np.flatnonzero(place >= order - 1 if order > 1 else word < 0)
                at = at[_passes(filter_, key[at])]
                known = _find(hot_keys, key[at])
                scores[at[known >= 0]] += hot_values[known[known >= 0]]
                asked.append((at[known < 0], key[at[known < 0]]))
            at, key = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.r_[firsts, len(word)])
            key = key[order]
            blobs = [key[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            return [by_text(1), by_text(token_known), by_text(base), rest, np.add.reduceat(scores, firsts), blobs]

        return run

    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *named, F.col(text).alias("t"))
    rows = cut_lineage(map_texts(rows, "t", fields, make, keep_text=False, most=STEP), "scored")
    rest = rows.select("row", F.explode("own_rest").alias("x")).select("row", "x.word", "x.k")
    rare = words.filter((F.length("word") > HEAD_BYTES) | (F.col("n") <= edge))
    part = F.log10((F.col("n") - discount) / max(total, 1))
    sums = rest.join(rare, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"), F.sum(F.col("k") * part).alias("part"))
    size, unknown = float(np.log10(total + kinds + 1)), float(np.log10(unknown))
    n_known = F.col("own_known") + F.coalesce("known", F.lit(0))
    tree = _looked_up(rows.select("row", "own_runs"), values, parts)
    return rows.drop("own_rest", "own_runs").join(sums, "row", "left").join(tree, "row", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        F.col("own_tokens").alias("n_tokens"),
        n_known.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("own_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("own_tokens") * size).alias("base_score"),
        (F.col("own_score") + F.coalesce("part", F.lit(0.0)) + F.coalesce("tree", F.lit(0.0)) + (F.col("own_tokens") - n_known) * unknown).alias("score"),
    )
