"""Toxicity by a linear-chain conditional random field over words.

Only documents are labelled, so token labels are derived first: a word of a toxic training document is toxic if the word or
its stem stands in many more surroundings in toxic than in other documents (surroundings, not documents, so that copies of one text
count once). The field has two states; a token's score comes from hashed features of the word and its neighbours.
Forward-backward marginals give the toxic spans; their sum and maximum, put through a logistic fit on the same
training documents, give the document's score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_texts

#: Most labelled documents of a class, and longest text in characters, in the training sample.
SAMPLE, SAMPLE_CHARS = 2000, 50_000
#: A toxic word or stem: surroundings in toxic texts, how much likelier there than elsewhere, bytes of a stem.
SURROUNDINGS, RATIO, STEM = 4, 20.0, 6
#: Hashed weights a feature kind; passes over the sample, documents at once, step, pull towards zero.
BITS, PASSES, BATCH, RATE, PULL = 16, 8, 50, 0.4, 1e-4
#: A span's tokens have at least this marginal; words a worker keeps features of.
SPAN, CACHE = 0.5, 300_000
_RUN = re.compile(rb"[^\x20\x09-\x0D]+")
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_"
_KINDS = ("word", "before", "after", "head", "tail")


def _bare(word: bytes) -> bytes:
    """A word without the signs around it (as it is, if it has nothing else)."""
    return word.strip(_STRIP) or word


def _features(word: bytes) -> tuple[int, int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word) & mask, zlib.crc32(b"^" + word[:STEM]) & mask, zlib.crc32(word[-4:] + b"$") & mask


def texts_words(texts: list[bytes]) -> list[list[bytes]]:
    return [[_bare(w) for w in raw.lower().split()] for raw in texts]


class Field:
    """Weights (toxic less clean) of each feature kind, of the 2 x 2 transitions, and of the logistic fit."""

    def __init__(self):
        self.weights = {k: np.zeros(1 << BITS, np.float32) for k in _KINDS}
        self.bias, self.transitions = -4.0, np.zeros((2, 2))
        self.logistic = np.array([-3.0, 1.0, 0.0, 0.0])

    def emissions(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of all tokens in a row; each text is given as its words' three hashed features."""
        w = self.weights
        out = []
        for word, head, tail in rows:
            e = self.bias + w["word"][word] + w["head"][head] + w["tail"][tail]
            e[1:] += w["before"][word[:-1]]
            e[:-1] += w["after"][word[1:]]
            out.append(e)
        return np.concatenate(out).astype(float) if out else np.empty(0)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state from the left, from the right and both, for all tokens of texts laid in a row.

    All texts go in step, the longest first, so that those still running are a prefix.
    """
    a = np.exp(transitions)
    order = np.argsort(-sizes, kind="stable")
    firsts = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    x = np.exp(np.clip(scores, -30, 30))
    left, right = np.empty(len(x)), np.empty(len(x))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    r = np.zeros(0)
    for t in range(longest):
        n = live[t]
        at = firsts[:n] + t
        r = x[at] * ((r[:n] * a[1, 1] + a[0, 1]) / (r[:n] * a[1, 0] + a[0, 0]) if t else 1.0)
        left[at] = r
    s = np.zeros(0)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = firsts[:n] + t
        ahead = np.ones(n)
        if len(s):
            y = x[firsts[: len(s)] + t + 1] * s
            ahead[: len(s)] = (a[1, 1] * y + a[1, 0]) / (a[0, 1] * y + a[0, 0])
        s = ahead
        right[at] = s
    return left, right, left * right


def _aggregate(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: 1, log of 1 + expected toxic tokens, largest log odds, log of 1 + tokens."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = np.flatnonzero(sizes)
    firsts = (np.cumsum(sizes) - sizes)[full]
    out[:, 2] = -10
    if len(full):
        out[full, 1] = np.log1p(np.add.reduceat(odds / (1 + odds), firsts))
        out[full, 2] = np.clip(np.log(np.maximum.reduceat(odds, firsts)), -10, 10)
    out[:, 3] = np.log1p(sizes)
    return out


def toxic_words(rows: list[np.ndarray], toxic: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Which words, by number: those that, or whose stem, stand in more surroundings in toxic texts, by ``RATIO``, than in others.

    ``rows``: each text's words by number; ``stems``: the stem's number of each word.
    """
    size = len(stems) + 1  # the last number is the edge of a text
    around = [np.r_[size - 1, r[:-1]] * size + np.r_[r[1:], size - 1] for r in rows if len(r)]
    word, around = np.concatenate([r for r in rows if len(r)]), np.concatenate(around)
    label = np.concatenate([np.full(len(r), y) for r, y in zip(rows, toxic) if len(r)])
    n = [1 + int((label == k).sum()) for k in (0, 1)]
    bad = np.zeros(size - 1, bool)
    for group in (np.arange(size - 1), stems):
        seen = []
        for k in (0, 1):
            own = group[word[label == k]]
            order = np.lexsort((around[label == k], own))
            own, place = own[order], around[label == k][order]
            new = np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1])][: len(own)]
            seen.append(np.bincount(own[new], minlength=size - 1))
        found = (seen[1] >= SURROUNDINGS) & ((seen[1] + 0.5) / n[1] >= RATIO * (seen[0] + 0.5) / n[0])
        bad |= found[group]
    return bad


def fit(texts: list[bytes], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Field:
    """Field and logistic fit of a bounded sample; the same sample in the same order gives the same model.

    ``weights``: labelled documents for each sampled one, by class, so that scores are chances among all documents.
    """
    y = np.array(toxic, int)
    field = Field()
    if not len(y) or y.min() == y.max():
        return field
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for raw in texts for words in texts_words([raw])]
    if not number:
        return field
    stem: dict[bytes, int] = {}
    stems = np.array([stem.setdefault(w[:STEM], len(stem)) for w in number], np.int64)
    features = np.array([_features(w) for w in number], np.int64)
    del number, stem
    bad = toxic_words(rows, y, stems)
    coded = [tuple(features[r].T) for r in rows]
    marks = [(bad[r] & bool(label)).astype(float) for r, label in zip(rows, y)]
    squares = {k: np.full(1 << BITS, 1e-2) for k in _KINDS}
    order = np.argsort([len(r) for r in rows], kind="stable")
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    steps = np.random.default_rng(7)
    free = np.full((2, 2), 1e-2)
    bias = 1e-2
    for _ in range(PASSES):
        for b in steps.permutation(len(batches)):
            own = [i for i in batches[b] if len(rows[i])]
            if not own:
                continue
            part, sizes = [coded[i] for i in own], np.array([len(rows[i]) for i in own])
            truth = np.concatenate([marks[i] for i in own])
            scores = field.emissions(part)
            left, right, odds = forward_backward(scores, sizes, field.transitions)
            gap = truth - odds / (1 + odds)
            inner = np.ones(len(truth), bool)
            inner[np.cumsum(sizes) - sizes] = False
            at = np.flatnonzero(inner)
            l, e = left[at - 1], np.exp(np.clip(scores[at], -30, 30)) * right[at]
            a = np.exp(field.transitions)
            pair = np.stack([np.full(len(at), a[0, 0]), a[0, 1] * e, a[1, 0] * l, a[1, 1] * l * e])
            expected = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
            real = np.bincount((truth[at - 1] * 2 + truth[at]).astype(int), minlength=4).reshape(2, 2)
            slope = (real - expected) / len(own) - PULL * field.transitions
            free += slope**2
            field.transitions += RATE * slope / np.sqrt(free)
            slope = gap.sum() / len(own)
            bias += slope**2
            field.bias += RATE * slope / np.sqrt(bias)
            word, head, tail = (np.concatenate(x) for x in zip(*part))
            for kind, where, g in (("word", word, gap), ("head", head, gap), ("tail", tail, gap), ("before", word[at - 1], gap[at]), ("after", word[at], gap[at - 1])):
                slopes = np.bincount(where, g, 1 << BITS) / len(own) - PULL * field.weights[kind]
                squares[kind] += slopes**2
                field.weights[kind] += (RATE * slopes / np.sqrt(squares[kind])).astype(np.float32)
    sizes = np.array([len(r) for r in rows])
    x = _aggregate(forward_backward(field.emissions([c for c in coded if len(c[0])]), sizes[sizes > 0], field.transitions)[2], sizes)
    field.logistic = _logistic(x, y, np.array(weights)[y])
    return field


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> tuple[list[bytes], list[int], tuple[float, float]]:
    """At most ``most`` labelled texts a class, of at most ``SAMPLE_CHARS`` characters, in order of a hash of the id; the labels; weights for ``fit``.

    A document with several labels is toxic if one of them says so; null ids, labels and texts teach nothing.
    """
    named = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("i")).agg(F.max(label).alias("y")).filter("i is not null")
    taught = named.join(docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("i")).distinct(), "i", "left_semi")
    total = {r.y: r["count"] for r in taught.groupBy("y").count().collect()}
    rows = []
    for y in (0, 1):
        chosen = taught.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most)  # ids only, so they can be broadcast
        found = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(F.length("t") <= SAMPLE_CHARS).join(F.broadcast(chosen), "i")
        found = found.groupBy("i").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i")
        rows += [(bytes(r.t), y) for r in found.select(F.col("t").cast("binary").alias("t")).collect()]
    labels_ = [y for _, y in rows]
    return [t for t, _ in rows], labels_, tuple(total.get(y, 0) / max(labels_.count(y), 1) for y in (0, 1))


def score(docs: DataFrame, field: Field, text: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``docs`` plus score (0 to 1) and toxic_spans: start and end in code points and p, of runs of tokens whose marginals reach ``SPAN``.

    Null and empty texts have no spans and the score of a text without tokens; repeated rows are scored alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    fields = [(prefix + "score", "double", pa.float64()), (prefix + "toxic_spans", "array<struct<start:int,end:int,p:double>>", kind)]

    def make():
        field, known = model.value, {}

        def run(texts: list[bytes]) -> list:
            rows = texts_words(texts)
            if len(known) > CACHE:
                known.clear()
            coded = []
            for words in rows:
                for w in words:
                    if w not in known:
                        known[w] = _features(w)
                if words:
                    coded.append(tuple(np.array([known[w] for w in words], np.int64).T))
            sizes = np.array([len(r) for r in rows], np.int64)
            odds = forward_backward(field.emissions(coded), sizes[sizes > 0], field.transitions)[2]
            p = 1 / (1 + np.exp(-np.clip(_aggregate(odds, sizes) @ field.logistic, -30, 30)))
            marginal = odds / (1 + odds)
            spans = []
            ends = np.cumsum(sizes)
            for raw, size, end in zip(texts, sizes, ends):
                own = marginal[end - size : end]
                hit = own >= SPAN
                if not hit.any():
                    spans.append([])
                    continue
                points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                places = [m.span() for m in _RUN.finditer(raw)]
                runs = np.flatnonzero(np.diff(np.r_[0, hit.astype(int), 0])).reshape(-1, 2)
                spans.append([{"start": int(points[places[a][0]]), "end": int(points[places[z - 1][1]]), "p": float(own[a:z].max())} for a, z in runs])
            return [p, spans]

        return run

    return map_texts(docs, text, fields, make, keep_text)
