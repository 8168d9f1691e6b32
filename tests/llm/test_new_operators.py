"""Prefix trie, whitening and packing against plain Python, on the driver's tables and on odd ones."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from llm_fixtures import odd_docs, odd_rows  # noqa: F401
from spacetide.llm import huffman_ids, packing, prefix_trie, suffix_tree, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def crc(c):
    return F.crc32(c.cast("string").cast("binary"))


def trie(df):
    found = prefix_trie.prefix_trie(df, lambda c: c - c % 5, lambda c: crc(c) % 9, 8)
    return sorted(map(tuple, found.collect()), key=lambda r: r[:2])


def trie_by_hand(rows):
    """Nodes from rebuilt tuples; turns of one number in the order the operator found them are given as they are."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), (r or "", x or "")))
    convs = {c: [p for _, p in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    rebuilt = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(rebuilt[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def test_trie_on_the_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = trie_by_hand(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))
    found = queries()["op11_conversation_prefix_trie"](spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want


ODD_TURNS = (
    [(c, t, "user", f"turn {t} of base {c // 5}") for c in range(40) for t in range(c % 4)]
    + [(100, t, "user", "long" if t % 3 else f"é{t}") for t in range(300)]
    + [(101, t, None, None) for t in (None, 3, 7)]
    + [(-7, 0, "user", "x" * 20_000), (-10, None, "user", "first"), (-10, 1, "a", "second")]
    + [(c, t, "user", "the same") for c in range(200, 260) for t in range(12)]
    + [(300, 5, "u", "t"), (300, 5, "u", "t"), (None, 1, "u", "none")]
)


def test_trie_on_odd_turns(spark):
    data = [(*r, "e", "e") for r in ODD_TURNS]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth string, h1 string").repartition(5)
    assert trie(df) == trie_by_hand(ODD_TURNS)
    assert trie(df.filter("false")) == []
    assert trie(df.filter("conv_id = 301 OR conv_id IS NULL")) == []


def test_trie_starts_over_when_contents_share_a_hash(spark, monkeypatch):
    real = prefix_trie._hashes
    weak = lambda role, text, seed: [F.lit(1).cast("long").alias(f"h{k}") for k in (1, 2)] if seed == 0 else real(role, text, seed)
    monkeypatch.setattr(prefix_trie, "_hashes", weak)
    df = spark.createDataFrame(ODD_TURNS[:60], "conv_id long, turn long, role string, text string")
    assert trie(df) == trie_by_hand(ODD_TURNS[:60])
    monkeypatch.setattr(prefix_trie, "_hashes", lambda role, text, seed: weak(role, text, 0))
    with pytest.raises(RuntimeError):
        trie(df)


def test_trie_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "u", "same") for c in range(0, 500, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie(df) == trie_by_hand(rows)


def test_eigenvectors_of_awkward_matrices():
    rng = np.random.default_rng(1)
    for trial in range(60):
        d, m = int(rng.integers(1, 24)), int(rng.integers(1, 40))
        a = np.cov(rng.standard_normal((m, d)).T, bias=True).reshape(d, d) * 10.0 ** int(rng.integers(-6, 7))
        if trial % 4 == 0:
            a = np.eye(d) * 3.0
        if trial % 4 == 1 and d > 3:
            a[2], a[:, 2] = a[3], a[:, 3]
            a = (a + a.T) / 2
        k = min(8, d)
        values, vectors = whitening.leading(a, k)
        size = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * size * d)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
        assert np.abs(a @ vectors - vectors * values).max() < 1e-10 * size * d


def white_by_hand(x):
    n = len(x)
    sums = [sum(int(v) for v in col) for col in x.T]
    y = np.array([[int(v) - s / n for v, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return e, y @ u / np.sqrt(np.where(e > 0, e, 1)), dev


def test_whitening_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 100_000
    e, white, dev = white_by_hand(x)
    found = queries()["op12_embedding_whitening"](spark, sf_dir).orderBy("vec_id", "component").toPandas()
    assert len(found) == 8 * len(rows) and (found["n"] == len(rows)).all()
    assert found["deviation"].tolist() == [v for v in dev for _ in range(8)]
    assert found["identity_error"].max() < 1e-9 and found["identity_error"].nunique() == 1
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 8), e[:8] / e.sum(), rtol=1e-9)
    got = found["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(got - white[:, :8] * np.sign((got * white[:, :8]).sum(axis=0))).max() < 1e-8


def test_whitening_of_odd_vectors(spark):
    good = [[0.5, -1.25, 3.0], [0.1, 7.5, -2.0], [0.5, -1.25, 3.0], [9.0, 0.0, 1.0], [1e3, -1e3, 5e2]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    data = [(i if i != 2 else 0, v, "e") for i, v in enumerate(good + bad)] + [(None, [2.0, 2.0, 2.0], "e")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n string").repartition(3)
    found = whitening.whiten(df).collect()
    x = np.floor(1024 * np.array([*good, [2.0, 2.0, 2.0]])).astype(np.int64) + 100_000
    e, _, dev = white_by_hand(x)
    assert len(found) == 6 and sorted(int(r.deviation) for r in found) == sorted(dev)
    assert all(len(r.whitened) == 3 and r.n == 6 and r.identity_error < 1e-6 for r in found)
    assert np.allclose(found[0].explained, e / e.sum(), rtol=1e-4)
    same = whitening.whiten(df.filter("vec_id = 0")).collect()
    assert len(same) == 2 and all(r.whitened == [] and r.explained == [] and r.deviation == 0 for r in same)
    assert whitening.whiten(df.filter("false")).collect() == []


def check_pieces(docs, found, capacity=1024):
    """Every id in one piece, no gaps, and the padding of all sequences."""
    coder = Tokenizer.from_file(BYTE_BPE)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, bytes(r.ids) if "ids" in r else r.ids_crc32))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert set(want) == set(pieces)
    for d, coded in want.items():
        if len(coded) > 1:  # documents of one id: as many ids
            assert sum(n for _, _, n, _ in pieces[d]) == sum(len(c) // 4 for c in coded)
            continue
        at = 0
        for tokens, start, length, value in sorted(pieces[d], key=lambda p: p[1]):
            part = coded[0][4 * start : 4 * (start + length)]
            assert start == at and tokens == len(coded[0]) // 4 and value in (part, zlib.crc32(part))
            at += length
        assert at == len(coded[0]) // 4
    return padding


def test_packing_of_whole_and_odd_tables(spark, sf_dir, odd_docs, odd_rows):  # noqa: F811
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert check_pieces(docs, queries()["op13_packing"](spark, sf_dir).collect()) == 0
    assert check_pieces(odd_rows, packing.pack(odd_docs, BYTE_BPE).collect()) == 0
    assert check_pieces(odd_rows, packing.pack(odd_docs, BYTE_BPE, capacity=8, checksums=True).collect(), 8) == 0
    assert packing.pack(odd_docs.filter("false"), BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, BYTE_BPE, capacity=1000)


def test_closest_subset_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(n): int(rng.integers(0, 4)) for n in rng.integers(1, 30, int(rng.integers(0, 6)))}
        capacity = int(rng.integers(1, 64))
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = packing.closest(counts, capacity)
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= capacity)


def test_plans_place_every_rest():
    rng = np.random.default_rng(5)
    cases = [{}, {700: 1000}, {5: 1}, {1023: 7, 1: 3}, {600: 5, 700: 3}, {1: 5000}, {512: 3}]
    cases += [{int(n): int(c) for n, c in zip(rng.integers(1, 1024, 200), rng.integers(1, 10_000, 200))}]
    for counts in cases:
        table, sequences = packing.plan(counts, 1024)
        total = sum(n * c for n, c in counts.items())
        assert (table[:, 2] * table[:, 4]).sum() == total and total / 1024 <= sequences <= total / 1024 + 10
        seen = defaultdict(int)
        for source, _, count, begin, length, _, _ in table.tolist():
            assert 0 <= begin and begin + length <= source
            seen[source] += count * length
        assert seen == {n: n * c for n, c in counts.items()}


def test_added_tokens_as_the_library_finds_them():
    coder = Tokenizer.from_file(BYTE_BPE)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>", "<|endoftext|> é", "<|endof", "in<|endoftext|>side", "", "plain text"]
    ids = huffman_ids.text_ids([t.encode() for t in texts], BYTE_BPE)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_filter_and_floor_come_to_the_driver_in_pieces(spark, monkeypatch):
    """A filter holds all keys, of which the driver never takes more than PIECES pieces of a task at once; no rows are sorted there."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    monkeypatch.setattr(suffix_tree, "PIECE", 1 << 8)
    monkeypatch.setattr(suffix_tree, "PIECES", 2)
    sizes, whole = [], Classic.toArrow

    def seen(self):
        out = whole(self)
        sizes.append(out.nbytes)
        return out

    monkeypatch.setattr(Classic, "toArrow", seen)
    keys = spark.range(0, 3000, numPartitions=3).select(F.xxhash64("id").alias("key"))
    filter_ = suffix_tree._filter(keys, 1 << 11)
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    assert suffix_tree._passes(filter_, np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)).all()
    plain = np.zeros(1 << 11, np.uint64)
    at, bits = suffix_tree._bits(np.array([r.key for r in keys.collect()], np.int64).view(np.uint64), 1 << 11)
    np.bitwise_or.at(plain, at, bits)
    assert (filter_ == plain).all()
    counts = spark.range(100).select((F.col("id") % 10).alias("n"))
    assert [suffix_tree._floor(counts, most) for most in (0, 9, 10, 29, 99, 100)] == [9, 9, 8, 7, 0, 0]


def test_runs_are_gathered_in_one_buffer(monkeypatch):
    """Parts of any length pass whole and in order; sorted keys are dealt out by ranges, each bucket one row."""
    monkeypatch.setattr(suffix_tree, "RUNS", 10)
    parts = [np.arange(n, dtype=np.uint64) + np.uint64(100 * n) for n in (0, 3, 25, 10, 1)]
    got = [(a.copy(), b.copy()) for a, b in suffix_tree._filled(iter([(x, x) for x in parts]), ("<u8", "<u8"))]
    assert [len(a) for a, _ in got] == [10, 10, 10, 9]
    assert all((np.concatenate(x) == np.concatenate(parts)).all() for x in zip(*got))
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (1, 3, 32, 211):
        dealt = [(bucket, np.frombuffer(x, "<u8")) for b in suffix_tree._dealt(key, [key], n) for bucket, x in zip(*(c.to_pylist() for c in b.columns))]
        assert (np.concatenate([x for _, x in dealt]) == key).all()
        assert all(((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32) == np.uint64(bucket)).all() for bucket, x in dealt)
    assert not list(suffix_tree._dealt(key[:0], [key[:0]], 4))
