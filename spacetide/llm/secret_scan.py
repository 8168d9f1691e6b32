"""Secret scans: three fixed patterns, and a battery of randomness tests on every other long token.

A token's encoding is inferred from its characters and its symbols become numbers. Three tests ask whether it could be random:
chi-squared uniformity over the alphabet, runs above and below the middle, serial correlation; their p-values are combined
by Fisher's method. A second p-value says how rarely ordinary text of the corpus, by its character counts, would
look as uniform at that length. Among all tokens of the corpus, per length class, the Benjamini-Hochberg rule
then sets how small that value must be, so short tokens, which prove little, need more.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import fresh, map_texts, raw_texts, steps

#: The base patterns, and the least length of a finding.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Tokens of other kinds start at this length; share of false findings among them; least combined p-value of a random token.
LEAST, FALSE_SHARE, NOT_RANDOM = 16, 0.01, 0.01
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in the order of their values, the smallest that fits first.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]
#: Lengths at which a new class of tokens begins.
CLASSES = (16, 20, 24, 32, 48)
#: Steps per power of ten, and most steps, on the grid of p-values.
GRID, TOP = 20, 1000


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared (Wilson and Hilferty's cube root)."""
    c = 2 / (9 * df)
    return _tail(((max(x, 0.0) / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def _bins(size: int, n: int) -> int:
    """Parts of the alphabet that the uniformity test counts: more for longer tokens, each expecting four symbols or so."""
    return min(size, 1 << max(2, min(6, int(math.log2(n / 4)))))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds the token; none for mixed signs, numbers and words of one case without a digit."""
    used = set(token)
    if used <= set(_DIGITS):
        return None
    return next(((name, values) for name, letters, values in _SETS if used <= letters), None)


def tests(token: str, natural: np.ndarray) -> tuple[float, float] | None:
    """``(random, ordinary)``: combined p-value of randomness, and chance that ordinary text looks as uniform.

    ``natural``: corpus counts by byte. None where no encoding fits.
    """
    bare = token.rstrip("=")
    found = encoding(bare)
    if found is None:
        return None
    name, values = found
    size, n = len(values), len(bare)
    k = _bins(size, n)
    x = np.array([values[c] for c in bare])
    share = np.bincount(np.arange(size) * k // size, minlength=k) / size
    counts = np.bincount(x * k // size, minlength=k)
    chi = float(((counts - n * share) ** 2 / (n * share)).sum())
    high = x >= size / 2
    n1 = int(high.sum())
    n2 = n - n1
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if d.any() else 1.0
    p_serial = 2 * _tail(abs(r + 1 / n) * math.sqrt(n))
    logs = -sum(math.log(max(p, 1e-300)) for p in (chi_tail(chi, k - 1), p_runs, p_serial))
    random = math.exp(-logs) * (1 + logs + logs * logs / 2)
    weight = natural[[ord(c) for c in ALPHABETS[name]]] + 1.0
    p = np.bincount(np.arange(size) * k // size, weight / weight.sum(), k)
    ratio = p / share
    mean = float((p * (1 - p) / share).sum() + n * ((p - share) ** 2 / share).sum())
    var = float(2 * ((p * (1 - p) / share) ** 2).sum() + 4 * n * ((p * ratio * ratio).sum() - (p * ratio).sum() ** 2))
    return random, 1 - _tail((chi - mean) / math.sqrt(var))


def _base(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tokens(text: str, base: list[tuple[int, int, int]], natural: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``(start, end, class, step)`` of the tokens beside the fixed findings that could be random."""
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if any(a < end and start < z for a, _, z in base):
            continue
        found = tests(m[0], natural)
        if found is None:
            continue
        random, ordinary = found
        step = min(TOP, int(-math.log10(max(ordinary, 1e-60)) * GRID)) if random >= NOT_RANDOM else 0
        yield start, end, sum(len(m[0].rstrip("=")) >= c for c in CLASSES) or 1, step


def byte_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each byte occurs in all texts (256 numbers, summed in the tasks first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for part in chain.from_iterable(steps(b, 0) for b in batches):
            n += np.bincount(np.frombuffer(b"".join(raw_texts(part.column(0))), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in docs.select(text).mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def limits(docs: DataFrame, natural: np.ndarray, text: str = "text", false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Least step of a finding, by length class: Benjamini-Hochberg over all tokens of all texts.

    The tokens of a class are counted on a grid of p-values (at most CLASSES * TOP rows); a p-value counts as the upper end of its step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in chain.from_iterable(steps(b, 0) for b in batches):
            for raw in raw_texts(part.column(0)):
                line = raw.decode()
                found.update([(c, step) for _, _, c, step in _tokens(line, _base(line), natural)])
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], names=["c", "step", "n"])

    grid = np.zeros((len(CLASSES) + 1, TOP + 1), np.int64)
    for r in docs.select(text).mapInArrow(run, "c long, step long, n long").groupBy("c", "step").agg(F.sum("n").alias("n")).collect():
        grid[r.c, r.step] = r.n
    out = {}
    for c, row in enumerate(grid):
        as_small = np.cumsum(row[::-1])[::-1]
        good = np.flatnonzero((as_small > 0) & (10.0 ** (-np.arange(TOP + 1) / GRID) * row.sum() <= false_share * as_small))
        out[c] = int(good[0]) if len(good) else TOP + 1
    return out


def scan(docs: DataFrame, text: str = "text", redact: bool = False, keep_text: bool = True, column: str = "spans") -> DataFrame:
    """``docs`` with ``column``: array of (start, end, kind) of all findings in code points, by start, then kind.

    With ``redact`` the text column comes back with every finding (overlapping ones as one) replaced by its kind in
    brackets; a null text stays null. Null and empty texts have no findings; repeated rows have equal ones, and each
    counts in the corpus statistics. All texts are read three times: for the character counts, for the
    false-discovery limits and for the findings. Nothing but these two small tables passes through the driver.
    """
    natural = byte_counts(docs, text)
    least = limits(docs, natural, text)
    marked, clean = (column, *fresh(docs, "clean")) if column != "clean" else (column, *fresh(docs, "clean_text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    fields = [(marked, "array<struct<start:int,end:int,kind:string>>", kind)] + ([(clean, "string", pa.string())] if redact else [])

    def make():
        def run(texts: list[bytes]) -> list:
            spans, out = [], []
            for raw in texts:
                line = raw.decode()
                base = _base(line)
                found = sorted(base + [(a, 3, z) for a, z, c, step in _tokens(line, base, natural) if step >= least[c]])
                spans.append([{"start": a, "end": z, "kind": KINDS[k]} for a, k, z in found])
                if redact:
                    parts, at = [], 0
                    for a, k, z in found:
                        if a >= at:
                            parts += [line[at:a], f"[{KINDS[k]}]"]
                        at = max(at, z)
                    out.append("".join([*parts, line[at:]]))
            return [spans, out] if redact else [spans]

        return run

    found = map_texts(docs, text, fields, make, keep_text or redact)
    if not redact:
        return found
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.col(clean))).drop(clean)


def counted(kind: str, column: str = "spans"):
    """How many findings of a kind a row has."""
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")
