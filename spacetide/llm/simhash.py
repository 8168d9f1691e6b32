"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are computed where the texts lie; only 8 bytes a document travel. Equal fingerprints are merged
first, so exact copies cost one row however many there are. Every distinct fingerprint is dealt to the six upper nodes
made by two of its four 16-bit quarters: two fingerprints at most two bits apart agree on two
quarters at least, so each link lies below some upper node. Below a node the codes are sorted by Gray rank and cut
into leaves; inner nodes keep the bit pattern that all their codes share, and a pair of nodes is dropped as
soon as the differences on bits that both sides share exceed the radius. Nodes that already lie in one component are
not compared again, so a dense group of near copies costs its leaves, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components
from .text import fresh, map_texts

#: Words in a shingle and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 3, 2
#: Codes in a leaf, children of an inner node.
LEAF, FAN = 16, 4
_QUARTERS = list(combinations(range(4), 2))
#: Shingles whose bits are counted at once; node pairs that are compared at once.
_BLOCK, _PAIRS = 1 << 16, 1 << 18


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[min(width, len(words)) :]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(ends), _BLOCK):
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint. Null and wordless texts have fingerprint 0."""
    return map_texts(docs, text, [(column, "long", pa.int64())], lambda: lambda texts: [[fingerprint(x, width) for x in texts]])


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray order (as a signed long, which keeps neighbours together)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest member reachable over the links, per position."""
    roots = np.arange(n) if roots is None else roots
    while len(a):
        low = np.minimum(roots[a], roots[b])
        np.minimum.at(roots, roots[a], low)
        np.minimum.at(roots, roots[b], low)
        while not np.array_equal(up := roots[roots], roots):
            roots = up
        open_ = roots[a] != roots[b]
        a, b = a[open_], b[open_]
    return roots


def _descend(codes: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """Roots after linking all codes (sorted by Gray rank) that differ in ``radius`` bits or fewer."""
    levels, ones, zeros = [], codes, ~codes
    size = LEAF
    while True:  # bits that all codes below a node have set, or all have clear
        cut = np.arange(0, len(ones), size)
        ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
        levels.append((ones, zeros, size))
        if len(ones) == 1:
            break
        size = FAN
    span = LEAF * FAN ** np.arange(len(levels))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > _PAIRS:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        if level < 0:
            near = np.bitwise_count(codes[i] ^ codes[j]) <= radius
            roots = _local_roots(len(codes), i[near], j[near], roots)
            continue
        ones, zeros, _ = levels[level]
        apart = np.bitwise_count((ones[i] & zeros[j]) | (zeros[i] & ones[j]))
        cut = np.arange(0, len(codes), span[level])
        low, high = np.minimum.reduceat(roots, cut), np.maximum.reduceat(roots, cut)
        joined = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
        go = (apart <= radius) & ~joined
        i, j = i[go], j[go]
        if not len(i):
            continue
        fan = levels[level][2]
        below = len(levels[level - 1][0]) if level else len(codes)
        x, y = np.divmod(np.arange(fan * fan), fan)
        left, right = (i[:, None] * fan + x).ravel(), (j[:, None] * fan + y).ravel()
        keep = (left <= right if level else left < right) & (right < below)
        stack.append((level - 1, left[keep], right[keep]))
    return roots


def _link_block(keys: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of whole groups of equal keys, each sorted by Gray rank."""
    n, codes = len(codes), codes.view(np.uint64)  # bits of negative numbers are counted on their absolute value
    left, right = [], []
    for lag in range(1, min(LEAF, n)):
        near = np.flatnonzero((keys[lag:] == keys[:-lag]) & (np.bitwise_count(codes[lag:] ^ codes[:-lag]) <= radius))
        left.append(near)
        right.append(near + lag)
    roots = _local_roots(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, n])
    for at, size in zip(first[sizes > LEAF], sizes[sizes > LEAF]):
        roots[at : at + size] = _descend(codes[at : at + size], roots[at : at + size] - at, radius) + at
    child = np.flatnonzero(roots != np.arange(n))
    return codes[child].view(np.int64), codes[roots[child]].view(np.int64)


def links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges ``(a, b)`` that join exactly the codes within ``radius`` (2 at most) bits; ``codes`` holds distinct longs ``code``.

    An upper node's codes come to one task in Gray order, as a stream; a node holds distinct codes only, which
    agree on half of their bits.
    """
    if radius > 2:
        raise ValueError("two of four quarters agree only up to radius 2")

    def quarter(k: int) -> Column:
        return F.shiftrightunsigned(F.col("code"), 16 * k).bitwiseAND(F.lit(0xFFFF))

    node = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(quarter(p), 16)).bitwiseOR(quarter(q)) for k, (p, q) in enumerate(_QUARTERS)])
    dealt = codes.select(F.explode(node).alias("node"), "code")
    sorted_ = dealt.repartition("node").sortWithinPartitions("node", gray_rank(F.col("code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 2

        def out(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            a, b = _link_block(keys, codes, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            kept = [np.concatenate([k, np.asarray(c)]) for k, c in zip(kept, batch.columns)]
            keys = kept[0]
            if len(keys) > _BLOCK and (cut := int(np.searchsorted(keys, keys[-1]))):
                yield out(keys[:cut], kept[1][:cut])
                kept = [k[cut:] for k in kept]
        if len(kept[0]):
            yield out(*kept)

    return sorted_.mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, radius: int) -> DataFrame:
    """``(doc_id, code, root, component_id)`` per row; root is one code of the component."""
    (mark,) = fresh(docs.select(doc_id), "fingerprint")
    marked = cut_lineage(fingerprints(docs.select(doc_id, text), text, mark, width).drop(text), "fingerprints")
    marked = marked.select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("code"))
    nodes = cut_lineage(marked.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    joined = components(links(nodes.select("code"), radius)).withColumnRenamed("node", "code")
    least = joined.join(nodes, "code").groupBy("root").agg(F.min("first").alias("least"))
    of = nodes.join(joined.join(least, "root"), "code", "left")
    of = of.select("code", F.coalesce("root", "code").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return marked.join(of, "code")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint long, component_id)`` of every row, component_id the smallest doc_id reachable over links.

    Null ids count only where a component has no other (component_id is then null); repeated rows give repeated
    rows; null and wordless texts have fingerprint 0 and are linked like any other; an empty table gives no rows.
    """
    return _classes(docs, doc_id, text, width, radius).select("doc_id", F.col("code").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of every component one row with its smallest doc_id, all columns kept.

    Rows that share that id and fingerprint are told apart no further: one of them stays. A component whose ids are all
    null keeps one row of its smallest fingerprint.
    """
    found = _classes(docs, doc_id, text, width, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    mark, key, keep_mark, keep_key = fresh(docs, "mark", "key", "keep_mark", "keep_key")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  a null id is a key too
    keep = found.groupBy("root").agg(F.min("code").alias(keep_mark), F.first(name("component_id")).alias(keep_key)).drop("root")
    marked = fingerprints(docs, text, mark, width).withColumn(key, name(doc_id))
    stay = marked.join(keep, (F.col(mark) == F.col(keep_mark)) & (F.col(key) == F.col(keep_key)), "left_semi")
    return stay.dropDuplicates([mark, key]).select(*docs.columns)
