"""Packing of token ids into sequences of one capacity by minimum bin slack.

Documents are cut into full windows, which are sequences already, and a rest shorter than one. The counts of rests by length (one number for each
length below the capacity, whatever the corpus) are all the driver needs: a bitset subset-sum picks the lengths that fill a window closest
to its capacity, the counts are followed back, and one choice serves as many windows as the counts allow. A slack that no
rests fill is filled by cutting one more. Tasks then find their rests' places from their ranks in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .byte_bpe import STEP
from .huffman_ids import text_ids
from .text import map_texts

#: Columns of a plan: rests of ``source`` ids with ranks ``first`` to ``first + count - 1`` give their ids ``begin`` to ``begin + length - 1`` to the
#: sequences ``sequence``, ``sequence + 1``, ..., there at ``offset``.
PLAN = ("source", "first", "count", "begin", "length", "sequence", "offset")


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often each length is used in the subset of largest sum up to ``capacity``: bitset subset-sum, longest lengths first, followed back."""
    reach, full, steps = 1, (2 << capacity) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= reach << length * chunk & full
            left -= chunk
            chunk *= 2
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            used[length] += chunk
            at -= length * chunk
    return dict(used)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows of PLAN that place all rests, and the number of sequences. ``counts``: rests by length.

    Every choice holds the longest rest and is repeated as often as the counts allow. Only what is left below one capacity
    at the end is not a full sequence: it becomes sequences of powers of two, which need no padding.
    """
    queues: dict[int, deque] = {n: deque([(n, 0, c, 0)]) for n, c in counts.items() if c}
    left = {n: c for n, c in counts.items() if c}
    rows, sequences = [], 0

    def put(length: int, many: int, take: int, sequence: int, offset: int) -> None:
        """The first ``many`` rests of ``length`` give ``take`` ids each; what stays of them is a rest of its own."""
        left[length] -= many
        while many:
            source, first, count, begin = queues[length].popleft()
            n = min(many, count)
            if n < count:
                queues[length].appendleft((source, first + n, count - n, begin))
            rows.append((source, first, n, begin, take, sequence, offset))
            if take < length:
                queues.setdefault(length - take, deque()).append((source, first, n, begin + take))
                left[length - take] = left.get(length - take, 0) + n
            sequence, many = sequence + n, many - n
        if not left[length]:
            del left[length], queues[length]

    while left:
        if sum(n * c for n, c in left.items()) < capacity:
            room = capacity
            while left:
                total = sum(n * c for n, c in left.items())
                room = 1 << total.bit_length() - 1
                offset = 0
                while offset < room:
                    longest = max(left)
                    take = min(longest, room - offset)
                    put(longest, 1, take, sequences, offset)
                    offset += take
                sequences += 1
            break
        longest = max(left)
        others = left | {longest: left[longest] - 1}
        used = closest(others, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = capacity - sum(n * c for n, c in used.items())
        needs, cut = dict(used), None
        if slack:  # every other rest is longer than the slack
            cut = max(n for n, c in left.items() if c > used.get(n, 0))
            needs[cut] = needs.get(cut, 0) + 1
        many = min(left[n] // c for n, c in needs.items())
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                put(length, many, length, sequences, offset)
                offset += length
        if slack:
            put(cut, many, slack, sequences, offset)
        sequences += many
    table = np.array(rows, np.int64).reshape(-1, len(PLAN))
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, doc_id: str = "doc_id", text: str = "text", checksums: bool = False) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row a piece.

    A document is the ids of its text by the tokenizers library and the id ``end`` (null and empty texts: that id alone). start: ids of
    the document before the piece; offset: ids of the sequence before it. Each id lies in one piece, sequence ids and offsets have no
    gaps. All sequences but the last ten at most are full; those have powers of two as their sizes. ``checksums``: the ids' unsigned
    CRC32 (``ids_crc32``) instead of the ids, which then do not travel.

    Rows of equal or null ids are documents of their own; a long text is any number of pieces; no rows give no pieces. Which of equally
    long rests goes where depends on how the table is split over tasks. Only the two named columns are looked at.
    """
    spark = docs.sparkSession
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two")
    kind, arrow = ("long", pa.int64()) if checksums else ("binary", pa.binary())
    name = "ids_crc32" if checksums else "ids"
    digest = zlib.crc32 if checksums else bytes
    stop, wide = np.array([end], "<u4").tobytes(), 4 * capacity
    fields = [("n", "long", pa.int64()), ("full", f"array<{kind}>", pa.list_(arrow)), ("rest", "binary", pa.binary()), ("part", "long", pa.int64()), ("nth", "long", pa.int64()), ("row", "long", pa.int64()), ("window", "long", pa.int64())]

    def make():
        seen, part = np.zeros(capacity, np.int64), TaskContext.get().partitionId()
        row = window = 0

        def run(texts: list[bytes]) -> list:
            nonlocal row, window
            coded = [ids + stop for ids in text_ids(texts, tokenizer)]
            sizes = [len(x) // 4 for x in coded]
            full = [[digest(x[i : i + wide]) for i in range(0, len(x) // wide * wide, wide)] for x in coded]
            rest = [x[len(x) // wide * wide :] for x in coded]
            nth = []
            for n in sizes:
                nth.append(int(seen[n % capacity]))
                seen[n % capacity] += 1
            rows = range(row, row := row + len(texts))
            windows = np.r_[window, window + np.cumsum([len(x) for x in full])]
            window = int(windows[-1])
            return [sizes, full, rest, [part] * len(texts), nth, rows, windows[:-1]]

        return run

    coded = map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", fields, make, keep_text=False, most=STEP)
    path = scratch_path(spark, "packing")
    coded.write.option("compression", "zstd").parquet(path)
    stage = spark.read.schema(coded.schema).parquet(path)
    rests = stage.select("doc_id", "n", (F.col("n") % capacity).cast("int").alias("source"), "part", "nth", "row", *([F.crc32("rest").alias("value")] if checksums else [])).filter("source > 0")
    counts = rests.groupBy("source", "part").agg(F.count("*").alias("many"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    offsets = counts.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    table, packed = plan({r["source"]: r["many"] for r in counts.groupBy("source").agg(F.sum("many").alias("many")).collect()}, capacity)  # below the capacity
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        low, high = (rows[:, 0] << 44) + rows[:, 1], (rows[:, 0] << 44) + rows[:, 1] + rows[:, 2]
        for batch in batches:
            source, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("source", "rank"))
            keys = (source << 44) + rank
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            begins, ends = np.searchsorted(keys, low), np.searchsorted(keys, high)
            hit = np.flatnonzero(ends > begins)
            many = (ends - begins)[hit]
            run = np.repeat(hit, many)
            item = order[np.repeat(begins[hit] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            made = [rows[run, 3], rows[run, 4], rows[run, 5] + rank[item] - rows[run, 1], rows[run, 6]]
            taken = batch.take(pa.array(item))
            yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in stay], *[pa.array(m) for m in made]], names=[*stay, "begin", "length", "sequence_id", "offset"])

    stay = ["doc_id", "n", "source", "part", "row", *(["value"] if checksums else [])]
    ranked = rests.join(offsets, ["source", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select(*stay, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank") + ", begin long, length long, sequence_id long, offset long"
    placed = ranked.mapInArrow(place, schema)
    result = ["doc_id", "start", "length", name, F.col("n").alias("doc_tokens"), "sequence_id", "offset"]
    start = F.col("n") - F.col("source") + F.col("begin")
    placed = placed.withColumn("start", start)
    cut = placed if not checksums else cut_lineage(placed.filter("length < source"), "cut")  # few: their size decides how rests find them
    own = F.expr("substring(rest, cast(4 * begin + 1 AS int), cast(4 * length AS int))")
    pieces = cut.join(stage.select("part", "row", "rest"), ["part", "row"]).withColumn(name, F.crc32(own) if checksums else own).select(*result)
    if checksums:
        pieces = pieces.union(placed.filter("length = source").withColumn(name, F.col("value")).select(*result))
    windows = stage.filter(F.size("full") > 0)
    bases, at = [], packed
    totals = windows.groupBy("part").agg(F.max(F.col("window") + F.size("full")).alias("many")).orderBy("part").collect()  # a row a task
    for part, many in totals:
        bases.append((part, at))
        at += many
    known = spark.createDataFrame(bases, "part long, base long")
    whole = windows.join(known, "part").select("doc_id", "n", (F.col("base") + F.col("window")).alias("first"), F.posexplode("full").alias("k", name))
    whole = whole.withColumns({"start": F.col("k").cast("long") * capacity, "length": F.lit(capacity).cast("long"), "sequence_id": F.col("first") + F.col("k"), "offset": F.lit(0).cast("long")})
    return whole.select(*result).union(pieces)
