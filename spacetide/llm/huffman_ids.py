"""Token ids in a binary format: canonical length-limited Huffman codes from global counts.

A folder holds three tables. ``codes``: a code length per id; canonical codes follow from the lengths. ``blocks``: ids of
consecutive documents as one bit stream each, with the bit offset of every CHECK ids of a document, so that a block is decoded
without any other and all its stretches side by side, through one table. ``index``: where the ids of each part begin. Documents are
in ascending order of their id over the parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import drop_path, scratch_path
from .byte_bpe import STEP, PieceCache, coded_pieces
from .text import fresh, map_texts, raw_texts, steps

#: Longest code in bits; ids between two checkpoints; ids after which a block is closed.
LIMIT, CHECK, BLOCK = 20, 64, 1 << 16
#: Ids of a part.
PART = 1 << 22
#: Pieces whose ids a worker keeps.
PIECES = 1_200_000


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_BYTE_SIGNS = _byte_signs()


@lru_cache(2)
def _cache(path: str) -> PieceCache:
    """Piece -> ids by the tokenizers library. A byte-level tokenizer cuts a text into pieces before it merges,
    so encoding each distinct piece once gives what encoding the whole text gives."""
    merges = Tokenizer.from_file(path).model
    return PieceCache(lambda piece: [t.id for t in merges.tokenize(piece.decode("latin-1").translate(_BYTE_SIGNS))], PIECES)


@lru_cache(2)
def _added(path: str) -> tuple[re.Pattern | None, dict[bytes, bytes]]:
    """What finds the file's added tokens in a text, the longest first, and their ids as bytes. They are found in the text as it is."""
    with open(path, "rb") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    ids = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in tokens}
    pattern = b"|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True))
    return (re.compile(b"(" + pattern + b")") if ids else None), ids


def text_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text (little-endian unsigned 32-bit) as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them: a text is split at
    the added tokens, which have ids of their own, and what stands between is cut into pieces."""
    pattern, added = _added(path)
    holders = {i: pattern.split(t) for i, t in enumerate(texts) if pattern and pattern.search(t)}
    if not holders:
        return coded_pieces(texts, _cache(path))
    spans, places = [], []
    for i, text in enumerate(texts):
        parts = holders.get(i, [text])
        spans += parts[::2]
        places.append(parts[1::2])
    coded = iter(coded_pieces(spans, _cache(path)))
    return [b"".join([next(coded), *chain.from_iterable((added[t], next(coded)) for t in marks)]) for marks in places]


def token_ids(docs: DataFrame, path: str, end: int, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` without its text but with the ids and the end id (little-endian unsigned 32-bit) in ``column``.

    ``path``: a byte-level BPE file of the tokenizers library, present on every node. Null and empty texts have the end id only.
    """
    stop = np.array([end], "<u4").tobytes()

    def make():
        def run(texts: list[bytes]) -> list:
            return [[ids + stop for ids in text_ids(texts, path)]]

        return run

    return map_texts(docs, text, [(column, "binary", pa.binary())], make, keep_text=False, most=STEP)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur, 1 for a single one."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    items, levels = leaves, []
    for _ in range(limit):
        leaf = np.ones(len(items), bool) if items is leaves else leaf  # noqa: F821
        levels.append(leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[leaves, pairs]
        place = np.argsort(both, kind="stable")
        items, leaf = both[place], place < len(leaves)
    take = 2 * len(used) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by id: counted up in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Book:
    """Encoding by id and decoding by table of one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths).astype(np.uint64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (LIMIT - self.lengths[order])
        self.table = np.zeros(1 << LIMIT, np.uint32)  # id * 32 + length for every possible next LIMIT bits
        self.table[: int(spans.sum())] = np.repeat((order << 5 | self.lengths[order]).astype(np.uint32), spans)

    def encode_all(self, rows: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """Per row its bit stream, padded to whole bytes, and the bit offset of every CHECK ids; all rows are laid out at once."""
        many = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        ends, stops = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(many)]
        first_bits = ends[stops]
        edges = np.r_[0, np.cumsum(-(-np.diff(first_bits) // 8))]  # every row begins at a byte
        at = ends[:-1] - np.repeat(first_bits[:-1], many)
        starts = at + np.repeat(8 * edges[:-1], many)
        out = np.zeros(int(edges[-1]) + 4)
        window = self.codes[ids] << (32 - (starts & 7) - size).astype(np.uint64)  # the code within the four bytes it may touch
        for k in range(4):
            part = (window >> np.uint64(24 - 8 * k)) & np.uint64(255)
            out += np.bincount((starts >> 3) + k, part, len(out))
        stream, at = out.astype(np.uint8).tobytes(), at.astype(np.uint32)
        cuts, places = edges.tolist(), stops.tolist()
        return [(stream[a:b], at[i:j:CHECK]) for a, b, i, j in zip(cuts, cuts[1:], places, places[1:])]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream of one row, padded to whole bytes, and the bit offset of every CHECK ids."""
        return self.encode_all([ids])[0]

    def decode(self, stream: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids; ``counts``: how many follow each checkpoint."""
        data = np.r_[np.frombuffer(stream, np.uint8), np.zeros(8 + CHECK * LIMIT // 8, np.uint8)].astype(np.uint64)
        window = data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16) | data[2:-1] << np.uint64(8) | data[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((CHECK, len(at)), np.uint32)
        mask = np.uint64((1 << LIMIT) - 1)
        for k in range(CHECK):
            found = self.table[(window[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint64)) & mask]
            out[k] = found >> 5
            at = at + (found & 31)
            at = np.minimum(at, 8 * len(window) - 1)
        return out.T[np.arange(CHECK) < counts[:, None]]


def _added_up(tables: DataFrame, column: str) -> np.ndarray:
    """Sum of the tables (little-endian 64-bit counts by id) of all rows; no more rows are shuffled than a task's tables have ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = _plus(n, np.frombuffer(raw, "<i8"))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    rows = tables.select(column).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"]
    return out


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def coded_and_counted(docs: DataFrame, path: str, end: int, doc_id: str, text: str, names: tuple[str, str]) -> DataFrame:
    """``(doc_id, ids, counts)``: a row for each document, and one of counts by id for each task (its other columns are null)."""
    stop = np.array([end], "<u4").tobytes()
    chosen = docs.select(doc_id, text)
    schema = T.StructType([chosen.schema[0], T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kind = np.zeros(0, np.int64), None
        for batch in chain.from_iterable(steps(b, 1, STEP) for b in batches):
            kind = batch.column(0).type
            made = [ids + stop for ids in text_ids(raw_texts(batch.column(1)), path)]
            n = _plus(n, np.bincount(np.frombuffer(b"".join(made), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.nulls(len(made), pa.binary())], names=schema.fieldNames())
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=schema.fieldNames())

    return chosen.mapInArrow(run, schema)


def write(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", parts: int | None = None, counts: np.ndarray | None = None) -> None:
    """Write ``(doc_id, ids)`` rows to the folder ``path``; doc_id must be a number.

    Rows with a null id come first; rows of equal ids follow each other in order of their ids' bytes. Bounds between parts are
    quantiles of the doc_ids, and only coded streams are shuffled. ``coded`` is read more than once, so it should be a stored table.
    ``counts``: how often each id occurs, counted here if not known. ``parts``: files, by default one for each PART ids.
    """
    spark = coded.sparkSession
    if counts is None:
        counted = lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4")).astype("<i8").tobytes()], pa.binary())], names=["counts"]) for b in batches if b.num_rows)
        counts = _added_up(coded.select(ids).mapInArrow(counted, "counts binary"), "counts")
    lengths = code_lengths(counts)
    known = spark.sparkContext.broadcast(lengths)
    book = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id int, length int")
    book.coalesce(1).write.parquet(f"{path}/codes")
    parts = parts or int(counts.sum()) // PART + 1
    shares = [k / parts for k in range(1, parts)]
    cuts = coded.agg(F.percentile_approx(doc_id, shares, max(10_000, 20 * parts))).first()[0] if shares else None
    bounds = spark.sparkContext.broadcast(np.array(sorted(set(cuts or []))))
    kind = coded.schema[doc_id].dataType
    streams = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.IntegerType()), T.StructField("stream", T.BinaryType()), T.StructField("offsets", T.BinaryType()), T.StructField("part", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(known.value)
        for batch in chain.from_iterable(steps(b, 1) for b in batches):
            rows = [np.frombuffer(raw, "<u4") for raw in batch.column(1).to_pylist()]
            made = book.encode_all(rows)
            columns = [batch.column(0), pa.array([len(r) for r in rows], pa.int32()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())]
            parts_of = [0 if i is None else int(np.searchsorted(bounds.value, i)) for i in batch.column(0).to_pylist()]
            columns.append(pa.array(parts_of, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=streams.fieldNames())

    blocks = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("stream", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin = None, 0
        docs, sizes, checks, stream, n, bits_at = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            columns = [[part], [begin], [docs], [sizes], [np.concatenate(checks).astype("<u8").tobytes()], [b"".join(stream)]]
            return pa.RecordBatch.from_pydict({f.name: c for f, c in zip(blocks.fields, columns)}, schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([("part", pa.int32()), ("begin", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("sizes", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("stream", pa.binary())])
            for p, i, size, bits, offsets in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "stream", "offsets")]):
                if docs and (p != part or n >= BLOCK):
                    yield close()
                    begin = begin + n if p == part else 0
                    docs, sizes, checks, stream, n, bits_at = [], [], [], [], 0, 0
                part = p
                checks.append(np.frombuffer(offsets, "<u4").astype(np.uint64) + np.uint64(bits_at))
                bits_at += 8 * len(bits)
                docs.append(i)
                sizes.append(size)
                stream.append(bits)
                n += size
        if docs:
            yield close()

    rows = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(encode, streams)
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "stream")
    ordered.mapInArrow(pack, blocks).write.parquet(f"{path}/blocks")
    totals = spark.read.schema(blocks).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    index = totals.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    index.coalesce(1).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the folder; start: ids of all documents before it."""
    known = spark.read.parquet(f"{path}/codes").toPandas()
    lengths = np.zeros(int(known["id"].max()) + 1 if len(known) else 0, np.uint8)
    lengths[known["id"].to_numpy(np.int64)] = known["length"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("begin", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                begin, docs, sizes, checks, stream = (batch.column(c)[r].as_py() for c in ("begin", "doc_ids", "sizes", "checkpoints", "stream"))
                sizes = np.array(sizes, np.int64)
                lanes = -(-sizes // CHECK)
                counts = np.full(int(lanes.sum()), CHECK, np.int64)
                counts[np.cumsum(lanes) - 1] = sizes - (lanes - 1) * CHECK
                ids = book.decode(stream, np.frombuffer(checks, "<u8"), counts).astype("<u4")
                ends = np.cumsum(sizes)
                columns = [pa.array(docs, batch.schema.field("doc_ids").type.value_type), pa.array(begin + ends - sizes), pa.array(sizes), pa.array([ids[z - n : z].tobytes() for z, n in zip(ends, sizes)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    index = spark.read.parquet(f"{path}/index").select("part", "start")  # one row a part
    placed = blocks.join(F.broadcast(index), "part").withColumn("begin", F.col("begin") + F.col("start"))
    return placed.select("begin", "doc_ids", "sizes", "checkpoints", "stream").mapInArrow(decode, out).withColumnRenamed("begin", "start")


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, path: str | None = None) -> DataFrame:
    """Tokenize, write to ``path`` (a new folder in the shared folder by default) and read back."""
    spark = docs.sparkSession
    path, stage = path or scratch_path(spark, "token-ids"), scratch_path(spark, "ids")
    ids, counts = fresh(docs.select(doc_id), "ids", "counts")
    coded = coded_and_counted(docs, tokenizer, end, doc_id, text, (ids, counts))
    coded.write.option("compression", "zstd").parquet(stage)
    stored = spark.read.schema(coded.schema).parquet(stage)
    known = _added_up(stored.where(F.col(counts).isNotNull()), counts)
    write(stored.where(F.col(ids).isNotNull()).select(doc_id, ids), path, doc_id, ids, counts=known)
    drop_path(spark, stage)
    return read(spark, path)
