"""Byte-level BPE with vectorised pre-tokenisation.

Pieces are found without regular expressions. Every code point gets a class (letter, number, space that attaches to what
follows, other white space, apostrophe that opens a contraction, other), which folds in the two code points after
it. A class is a function from one of eight scanner states to the next; functions compose associatively, so blocks of
code points are composed side by side, the compositions are scanned, and each block is then replayed from its
true start state. The resulting slices of the text go through cached pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_texts

#: Code points in a block of the scan; pieces that a worker's cache holds before it starts anew.
WIDTH, CACHE = 64, 400_000
#: Text bytes that are cut into pieces at once.
STEP = 1 << 20
#: Pieces above this many bytes are merged with a heap instead of repeated scans.
LONG = 32

# scanner states
_NEW, _LETTER, _NUMBER, _OTHER, _WHITE, _SPACE, _TWO, _ONE = range(8)
# classes with their look-ahead; 9 more are the same classes at the first code point of a text
_L, _N, _O, _SP, _W, _WL, _A1, _A2 = range(8)
#: White space of the split pattern beyond ASCII and the ASCII part; fixed values (Unicode White_Space).
_WHITE_POINTS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FIRST = 9


def _machine() -> tuple[bytes, bytes]:
    """Next state and "a piece starts here", by ``class * 8 + state``."""
    step, start = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for state in range(8):
        for kind, into, joins in ((_L, _LETTER, (_SPACE, _LETTER)), (_N, _NUMBER, (_SPACE, _NUMBER)), (_O, _OTHER, (_SPACE, _OTHER)), (_SP, _SPACE, ()), (_W, _WHITE, (_WHITE,)), (_WL, _NEW, ()), (_A1, _ONE, ()), (_A2, _TWO, ())):
            to, new = into, state not in joins
            if kind in (_A1, _A2) and state in (_SPACE, _OTHER):  # no contraction inside a run of signs
                to, new = _OTHER, False
            if kind == _L and state in (_TWO, _ONE):
                to, new = (_ONE, False) if state == _TWO else (_NEW, False)
            step[kind * 8 + state], start[kind * 8 + state] = to, new
    for kind in range(8):
        step[(kind + _FIRST) * 8 : (kind + _FIRST) * 8 + 8] = step[kind * 8 + _NEW]
        start[(kind + _FIRST) * 8 : (kind + _FIRST) * 8 + 8] = 1
    return step.tobytes(), start.tobytes()


_STEP, _START = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white (as _W) or other, for every code point."""
    of = {"L": _L, "N": _N}
    kinds = np.fromiter((of.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[_WHITE_POINTS] = _W
    return kinds


def _look(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


def _entry_states(kinds: np.ndarray) -> np.ndarray:
    """State before each class, from the associative scan; ``kinds`` holds ``class * 8``."""

    def scan(maps: np.ndarray) -> np.ndarray:
        """States before each function of a sequence ``(n, 8)`` that starts in _NEW."""
        if len(maps) <= WIDTH:
            state, out = 0, np.empty(len(maps), np.uint8)
            for k in range(len(maps)):
                out[k], state = state, maps[k, state]
            return out
        n = -(-len(maps) // WIDTH)
        same = np.arange(8, dtype=np.uint8)
        blocks = np.vstack([maps, np.broadcast_to(same, (n * WIDTH - len(maps), 8))]).reshape(n, WIDTH, 8)
        whole = np.broadcast_to(same, (n, 8))
        for k in range(WIDTH):
            whole = np.take_along_axis(blocks[:, k], whole.astype(np.intp), axis=1)
        state, out = scan(whole), np.empty((n, WIDTH), np.uint8)
        row = np.arange(n)
        for k in range(WIDTH):
            out[:, k] = state
            state = blocks[row, k, state]
        return out.ravel()[: len(maps)]

    n = -(-len(kinds) // WIDTH)
    padded = np.zeros(n * WIDTH, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(n, WIDTH).T)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (n, 8))
    for k in range(WIDTH):
        maps = _look(_STEP, columns[k][:, None] + maps)
    state, out = scan(maps), np.empty((WIDTH, n), np.uint8)
    for k in range(WIDTH):
        out[k] = state
        state = _look(_STEP, columns[k] + state)
    return np.ascontiguousarray(out.T).ravel()[: len(kinds)]


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in a row, the bytes at which pieces begin there (and the end), and which piece each text begins with (and the end)."""
    joined = b"".join(texts)
    points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    if not len(points):
        return joined, np.zeros(1, np.int64), bounds
    sizes = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        sizes += points >= least
    ends = np.cumsum(sizes)
    text_ends = np.cumsum([len(t) for t in texts])
    stops = np.searchsorted(ends, text_ends, "right")  # code points up to each text's end
    firsts = np.r_[0, stops[:-1]]
    full = stops > firsts
    kinds = _classes()[points]
    last = np.zeros(len(points), bool)
    last[stops[full] - 1] = True
    white = kinds == _W
    ahead = np.r_[white[1:], True] | last
    kinds[white & ~ahead] = _WL
    kinds[white & ~ahead & (points == 32)] = _SP
    marks = np.flatnonzero((points == 39) & ~last)
    one = points[marks + 1]
    kinds[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
    marks, one = (x[~last[marks + 1]] for x in (marks, one))
    two = points[marks + 2]
    kinds[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = _A2
    kinds[firsts[full]] += _FIRST
    kinds *= 8
    starts = np.flatnonzero(_look(_START, kinds + _entry_states(kinds)))
    bounds[1:] = np.searchsorted(starts, stops)
    return joined, np.r_[(ends - sizes)[starts], len(joined)], bounds


def coded_pieces(texts: list[bytes], ids_of: dict[bytes, bytes]) -> list[bytes]:
    """Ids of each text: equal pieces are looked up once, their ids laid out by place."""
    joined, at, bounds = cut(texts)
    if not joined:
        return [b""] * len(texts)
    column = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
    names, edges = column.dictionary.buffers()[2].to_pybytes(), np.frombuffer(column.dictionary.buffers()[1], np.int64, len(column.dictionary) + 1).tolist()
    found = [ids_of[names[a:b]] for a, b in zip(edges, edges[1:])]
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    table, firsts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    index = np.asarray(column.indices)
    n = sizes[index]
    ends = np.cumsum(n)
    ids = table[np.repeat(firsts[index] - ends + n, n) + np.arange(int(n.sum()))].tobytes()
    cuts = (4 * np.r_[0, ends][bounds]).tolist()
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank (the leftmost of equals) is joined until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    if len(parts) <= LONG:
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:  # one of the two has been merged since
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [ranks[p] for p in parts if p]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: a base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class PieceCache(dict):
    """Piece -> its ids as little-endian 32-bit integers; emptied when full, so memory stays bounded."""

    def __init__(self, encode, most: int = CACHE):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self.encode(piece)
        ids = pack(f"<{len(got)}I", *got)
        if len(piece) <= 64 * LONG:
            self[piece] = ids
        return ids


@lru_cache(2)
def _cache(path: str) -> PieceCache:
    ranks = load_ranks(path)
    return PieceCache(lambda piece: merge(piece, ranks))


@lru_cache(2)
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and each id's start and length there."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    sizes = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text, little-endian unsigned 32-bit."""
    return coded_pieces(texts, _cache(path))


def decode_ids(ids: bytes, path: str) -> bytes:
    """Bytes that the ids stand for."""
    text, starts, sizes = _tokens(path)
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) and numbers.max() >= len(sizes):
        raise ValueError(f"id {numbers.max()} is not in the vocabulary")
    size = sizes[numbers]
    ends = np.cumsum(size)
    return text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - ends + size, size)].tobytes()


def token_offsets(ids: bytes, path: str) -> np.ndarray:
    """Byte offset at which each id's part of the text begins, and the text's length at the end."""
    return np.r_[0, np.cumsum(_tokens(path)[2][np.frombuffer(ids, "<u4")])]


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids", offsets: str | None = None, decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of every text as binary (little-endian unsigned 32-bit integers).

    ``path``: rank file, present on every node. ``offsets``: also a column with the byte offset of each id, as
    binary of little-endian unsigned 32-bit integers with the text's length at the end. ``decoded``: also a column with the bytes that
    the ids stand for, decoded in the same worker. Null and empty texts give no ids.
    """
    fields = [(name, "binary", pa.binary()) for name in (column, offsets, decoded) if name]

    def make():
        def run(texts):
            ids = encode_texts(texts, path)
            starts = [[token_offsets(x, path).astype("<u4").tobytes() for x in ids]] if offsets else []
            return [ids, *starts, *([[decode_ids(x, path) for x in ids]] if decoded else [])]

        return run

    return map_texts(docs, text, fields, make, keep_text, STEP)


def decode(df: DataFrame, path: str, ids: str = "ids", column: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with the bytes that each row's ids stand for (null ids: none). An id outside the vocabulary is an error."""
    return map_texts(df, ids, [(column, "binary", pa.binary())], lambda: lambda rows: [[decode_ids(x, path) for x in rows]], keep_ids, STEP)
