"""Benchmark decontamination with one Aho-Corasick automaton over the word windows of all test items.

Texts are normalised to words (A-Z lower-cased; letters, digits and everything beyond ASCII); each known word becomes one
symbol, so the automaton walks words, not characters, and a document is scanned once. Hits are mapped back to
code-point offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import raw_texts, steps, without

#: Words in a window; documents with at least this share of hit words (as 1 / n) are contaminated.
WINDOW, SHARE = 13, 20
#: Item text that one automaton holds. A benchmark beyond it is scanned by several automata, one after the other.
BLOCK_BYTES = 1 << 20
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Matcher:
    """The automaton of ``(item id, text)`` rows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, text in items:
            line = "".join([self._symbol(w) for w in normal_words(text)])
            for i in range(max(1, len(line) - window + 1) if line else 0):
                windows.setdefault(line[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for line, found in windows.items():
            self.automaton.add_word(line, (len(line), tuple(found)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def _symbol(self, word: bytes) -> str:
        """One character a word; surrogates are no characters, and 0 stands for every unknown word."""
        if word not in self.symbols:
            n = len(self.symbols) + 1
            self.symbols[word] = chr(n if n < 0xD800 else n + 0x800)
        return self.symbols[word]

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """``(first word, past the last word, items)`` of every window that occurs."""
        if self.empty or not words:
            return
        get = self.symbols.get
        for last, (size, items) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            yield last + 1 - size, last + 1, items


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of runs of hit words."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit, 0])).reshape(-1, 2)
    words = [m.span() for m in _RUN.finditer(text.translate(_WORD_BYTES))]
    points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(points[words[a][0]]), int(points[words[b - 1][1]])) for a, b in edges]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``docs`` plus n_words, n_hit, items (distinct ids, sorted as strings), spans (start, end in code points) and contaminated.

    A document word inside any occurrence of an item's window is hit; an item of fewer words than a window is one window.
    ``contaminated``: n_hit > 0 and share * n_hit >= n_words. Null texts have no words; items without
    words never occur; a null item id is the empty string; repeated items count by id; an empty benchmark hits
    nothing. ``prefix`` goes before the new columns' names; columns of ``docs`` that have these names are replaced.

    Items reach the tasks as broadcasts of at most about ``block_bytes`` each (their size is summed first); a task
    holds one automaton at a time, and scans the batch once for each block of items.
    """
    spark = docs.sparkSession
    added = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("spans", "array<struct<start:int,end:int>>"), ("contaminated", "boolean")]
    docs = without(docs, [prefix + n for n, _ in added], text)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).cast("binary").alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    shared = [spark.sparkContext.broadcast([(r.i, bytes(r.t)) for r in items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]) for b in range(blocks)]
    place = docs.columns.index(text)
    stay = [i for i in range(len(docs.columns)) if keep_text or i != place]
    schema = T.StructType([docs.schema.fields[i] for i in stay] + [T.StructField(prefix + n, T._parse_datatype_string(k)) for n, k in added])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_()]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Matcher(shared[0].value, window) if blocks == 1 else None
        for batch in batches:
            parts = list(steps(batch, place))
            marks: list[dict[int, np.ndarray]] = [{} for _ in parts]
            found: list[dict[int, set]] = [{} for _ in parts]
            sizes: list[list[int]] = [[] for _ in parts]
            for b in range(max(1, blocks)):
                matcher = only or Matcher(shared[b].value if blocks else [], window)
                for p, part in enumerate(parts):
                    for r, raw in enumerate(raw_texts(part.column(place))):
                        words = normal_words(raw)
                        if not b:
                            sizes[p].append(len(words))
                        for first, end, ids in matcher.hits(words):
                            marks[p].setdefault(r, np.zeros(len(words), np.int8))[first:end] = 1
                            found[p].setdefault(r, set()).update(ids)
            for p, part in enumerate(parts):
                hit = [int(marks[p][r].sum()) if r in marks[p] else 0 for r in range(part.num_rows)]
                texts = part.column(place)
                spans = [[{"start": a, "end": z} for a, z in _spans(texts[r].as_py().encode(), marks[p][r])] if r in marks[p] else [] for r in range(part.num_rows)]
                made = [sizes[p], hit, [sorted(found[p].get(r, ())) for r in range(part.num_rows)], spans, [h > 0 and share * h >= n for h, n in zip(hit, sizes[p])]]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in stay], *[pa.array(x, k) for x, k in zip(made, kinds)]], names=names)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they were."""
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return contamination(docs, benchmark, prefix=prefix, **options).filter(f"not {prefix}contaminated").select(*docs.columns)
