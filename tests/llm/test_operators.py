"""Each registered query against a plain version, on the driver's smallest tables and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from llm_fixtures import empty_dir, odd_dir, odd_docs, odd_rows  # noqa: F401
from spacetide.llm import byte_bpe, decontaminate, huffman_ids, quality, secret_scan, shards, simhash, suffix_tree, toxicity, urls
from spacetide.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
lower = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))


@pytest.fixture(scope="module", params=["sf", "odd"])
def case(request, spark, sf_dir, odd_dir):
    path = sf_dir if request.param == "sf" else odd_dir
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    return path, docs


def rows(spark, name, path):
    """Results by sorted tuples of named values."""
    return [r.asDict() for r in QUERIES[name](spark, path).collect()]


def multiset(found, *cols):
    return Counter(tuple(r[c] for c in cols) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


def test_clashing_columns_are_replaced(spark, odd_dir, odd_docs):
    """Extra columns named like results or helpers do no harm to the operators themselves."""
    n = odd_docs.count()
    labels, bench = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    found = [
        simhash.near_duplicates(odd_docs),
        simhash.fingerprints(odd_docs),
        decontaminate.contamination(odd_docs, bench),
        secret_scan.scan(odd_docs),
        quality.judged(odd_docs, labels),
        toxicity.score(odd_docs, toxicity.fit([b"a b", b"c d"], [0, 1])),
        suffix_tree.scored(odd_docs, odd_docs),
        byte_bpe.encode(odd_docs, public_tokenizers.path("byte_bpe_50k.tiktoken")),
        byte_bpe.decode(byte_bpe.encode(odd_docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.path("byte_bpe_50k.tiktoken")),
        huffman_ids.round_trip(odd_docs, public_tokenizers.path("byte_bpe_50k.json")),
        shards.sharded(odd_docs),
    ]
    for df in found:
        assert len({c.lower() for c in df.columns}) == len(df.columns)
        assert df.count() == n
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet").selectExpr("*", "'x' AS host", "'y' AS score", "'z' AS row", "'t' AS at")
    assert urls.judged(pages, URL_RULES).count() == pages.count()


def sliding_hash(text, width=3):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    sums = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        sums += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(grams))


def plain_components(docs):
    prints = np.array([sliding_hash(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2):
            root[find(int(j))] = find(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, f"{int(prints[i]):016x}", least[find(i)]) for i, (d, _) in enumerate(docs)], [find(i) for i in range(len(docs))]


def test_near_duplicates(spark, case):
    path, docs = case
    found = rows(spark, "op4_simhash_near_dedup", path)
    assert multiset(found, "doc_id", "fingerprint", "component_id") == Counter(plain_components(docs)[0])


@pytest.mark.parametrize("spread", [3, 9, 20])
def test_links_of_dense_groups(spark, spread):
    """Codes around few centres, in buckets far larger than a leaf: the components of all pairs within two bits."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    bits = rng.choice(64, spread, replace=False)
    codes = {int(c) for c in centres}
    for _ in range(1500):
        flips = sum(1 << int(b) for b in rng.choice(bits, min(spread, int(rng.integers(0, 7))), replace=False))
        codes.add(int(centres[rng.integers(3)]) ^ flips)
    signed = np.array(sorted(codes), np.uint64).view(np.int64)
    from spacetide.llm.graph import components

    frame = spark.createDataFrame([(int(c),) for c in signed], "code long")
    found = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    near = np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None]) <= 2
    label = np.arange(len(signed))
    while True:
        new = np.where(near, label[None], len(signed)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = {}
    for k, c in zip(label, signed):
        want.setdefault(int(k), []).append(int(c))
    got = {}
    for c in signed:
        got.setdefault(found.get(int(c), int(c)), []).append(int(c))
    assert sorted(want.values()) == sorted(got.values())


def test_components_of_a_path_and_a_hub(spark):
    from spacetide.llm.graph import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (200, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 400)]}


def test_one_of_each_keeps_one_row_a_component(spark, odd_docs, odd_rows):
    found = simhash.one_of_each(odd_docs)
    assert found.columns == odd_docs.columns
    triples, root = plain_components(odd_rows)
    want = {}
    for (d, _, least), k in zip(triples, root):
        want[k] = least
    assert Counter(r.doc_id for r in found.collect()) == Counter(want.values())


def test_contamination(spark, case):
    path, docs = case
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    want = Counter()
    for d, text in docs:
        w, hit, which = word.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    which |= windows[k]
        want[d, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    found = rows(spark, "op5_benchmark_decontamination", path)
    assert multiset(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_contamination_spans_and_blocks(spark):
    text = "Étude: THE quick brown fox, jumps over; the lazy dog - and, then some MORE words come along here"
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(5, "the Quick brown fox jumps over the lazy dog and then some more words"), (6, "more words")], "item_id long, text string")
    for block in (1 << 20, 8):  # one automaton, and one for each item
        r = decontaminate.contamination(docs, bench, prefix="f_", block_bytes=block).first()
        assert [text[s.start : s.end] for s in r.f_spans] == [text[text.index("THE") : text.index(" come")]]
        assert (r.f_items, r.f_n_hit, r.items) == (["5", "6"], 14, "x")
    assert decontaminate.contamination(docs, bench).first()["items"] == ["5", "6"]  # a column of a result's name is replaced
    assert decontaminate.clean(docs, bench).collect() == []


def test_secrets_base(spark, case):
    path, docs = case
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for d, text in docs:
        text = text or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        n = Counter(f[3] for f in found)
        line = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(found))
        want[d, n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest()] += 1
    found = rows(spark, "op2_secret_scans", path)
    assert multiset(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(3)
    letters = list(secret_scan.ALPHABETS["base62"])
    prose = "the meeting was postponed because internationalization and misunderstanding delayed telecommunications "
    docs = [(i, prose * 20 + "".join(rng.choice(letters, 40)) + " " + prose) for i in range(60)] + [(100 + i, prose * 21) for i in range(60)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    right = [i for i in range(60) if [(s.start, s.end, s.kind) for s in found[i]] == [(len(prose) * 20, len(prose) * 20 + 40, "random")]]
    assert len(right) >= 55
    assert not any(found[i] for i in [*range(100, 160), 200, 201])
    clean = {r.doc_id: r.text for r in secret_scan.scan(df, redact=True).collect()}
    assert clean[right[0]] == prose * 20 + "[random] " + prose
    assert clean[200] is None and clean[201] == ""


def test_overlapping_findings_are_redacted_as_one(spark):
    df = spark.createDataFrame([(1, "é token = 24be64439e3e49cf46b2d7c90f3602a3 end", "s")], "doc_id long, text string, clean string")
    r = secret_scan.scan(df, redact=True).first()
    assert r.text == "é [assign] end" and r.clean == "s"
    assert [s.kind for s in r.spans] == ["assign", "hex"]


def test_quality_base(spark, case):
    path, docs = case
    want = Counter()
    for d, text in docs:
        text = text or ""
        w = WORD.findall(text)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)] += 1
    found = rows(spark, "op9_quality_rules", path)
    assert multiset(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not r["kept"] for r in found if r["base_failed"])


def test_quality_overlapping_windows(spark):
    text = "x " * 12 + "one two three four five six seven eight nine"
    df = spark.createDataFrame([(text,)], "text string")
    names = ["w", "n", "c", "s", "l", "r", "f"]
    assert quality.with_base(df, "text", names).first().r == 12


def test_quality_counts_every_trusted_document(spark, monkeypatch):
    """No cap on trusted documents: each of them changes the scores, and the threshold is an exact order statistic of those held out."""
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 11} beta" + " gamma" * (i % 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    whole = {r.doc_id: (r.score, r.kept) for r in quality.judged(docs, labels).collect()}
    monkeypatch.setattr(quality, "TRUSTED", 5, raising=False)
    assert {r.doc_id: (r.score, r.kept) for r in quality.judged(docs, labels).collect()} == whole
    monkeypatch.setattr(quality, "LEAST_WORDS", 0)
    monkeypatch.setattr(quality, "LOST", 0.5)
    found = quality.judged(docs, labels).collect()
    held = sorted(r.score for r in found if r.doc_id < 50 and zlib.crc32(str(r.doc_id).encode()) % quality.HELD_OUT == 0)
    cut = held[math.ceil(len(held) * 0.5) - 1]
    assert len(held) > 3 and all(r.kept == (r.score >= cut and not r.base_failed) for r in found)


def test_quality_ratio_matches_plain_counts(spark):
    """The score, and the threshold from held-out trusted documents, recomputed from the bucket counts."""
    good = ["the old house by the sea stood alone and quiet while the rain fell on the roof all night long " + f"n{i}" for i in range(60)]
    bad = ["buy &&& now $$$ cheap | pills | click | here | win | cash | now | free | offer | deal | best | price | vip | x | y " + f"m{i}" for i in range(60)]
    docs = spark.createDataFrame([*enumerate(good), *enumerate(bad, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    n_trusted = {i for i in range(50) if zlib.crc32(str(i).encode()) % quality.HELD_OUT}
    counts = {r.bucket: (r.raw, r.trusted) for r in quality.gram_counts(docs.join(labels.filter("quality = 1").withColumnRenamed("quality", "q"), "doc_id", "left"), (docs.doc_id < 50) & (docs.doc_id.isin(list(n_trusted)))).collect()}
    n_raw, n_good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    weight = {b: math.log((t + quality.ADDED) / (r * n_good / n_raw + quality.ADDED)) for b, (r, t) in counts.items()}
    bucket = lambda *words: xx(*words) % quality.BUCKETS + (quality.BUCKETS if len(words) > 1 else 0)

    def xx(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    for i, text in [*enumerate(good), *enumerate(bad, 100)]:
        w = text.split()
        grams = [bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:])]
        assert found[i].score == pytest.approx(sum(weight[g] for g in grams) / len(grams), abs=1e-5)
    least = min(found[i].score for i in range(50) if i not in n_trusted)
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in found.values())
    assert all(found[i].kept for i in range(50)) and not any(found[i].kept for i in range(100, 160))


def test_shards(spark, case):
    path, docs = case
    found = rows(spark, "op3_sharding", path)
    raw = lambda t: (t or "").encode()
    assert multiset(found, "doc_id", "size", "text_crc32") == Counter((d, len(raw(t)) + 1, zlib.crc32(raw(t))) for d, t in docs)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in found)


def test_growing_moves_slots_only_where_needed(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "map")
    shards.store_map(shards.first_map(spark, 8), path)
    first = {r.virtual_slot: r.shard for r in shards.sharded(docs, 8, map_path=path).collect()}
    second = {r.virtual_slot: r.shard for r in shards.sharded(docs, 9, map_path=path).collect()}
    moved = [s for s in first if first[s] != second[s]]
    assert len(moved) < 0.4 * len(first) and sum(second[s] == 8 for s in moved) > 0.5 * len(moved)
    assert sorted(r.version for r in shards.load_map(spark, path, 0).select("version").distinct().collect()) == [0]
    assert shards.load_map(spark, path).first().version == 2
    assert shards.load_map(spark, path).count() == shards.SLOTS
    fewer = shards.sharded(docs, 7, map_path=path)
    assert {r.shard for r in fewer.select("shard").distinct().collect()} == set(range(7))


def test_url_rules(spark, odd_dir, sf_dir):
    for path in (odd_dir, sf_dir):
        pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url").collect()
        want = Counter()
        for r in pages:
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
            host, p = (lower(m[1]), m[2]) if m else ("", "")
            fits = [(h + q, v) for v, h, q in URL_RULES if (host == h or host.endswith("." + h)) and p.startswith(q)]
            want[(r.page_id, host, p, *max(fits, key=lambda f: len(f[0]), default=(None, None)))] += 1
        found = rows(spark, "op1_url_filters", path)
        assert all(r["verdict"] in ("allow", "block") for r in found)
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in found) == want


def test_url_model_matches_plain_counts(spark):
    train = [("http://a.b/good/good", True), ("http://a.c/goods", True), ("http://x.y/bad", False), ("http://x.z/badly", False)]
    model = urls.counted(spark.createDataFrame(train, "url string, accepted boolean"))
    tests = ["http://q.r/good", "http://q.r/bad", None, ""]
    found = {r.url: r.score for r in urls.scored(spark.createDataFrame([(u,) for u in tests], "url string"), model).collect()}
    k = urls.ORDER
    grams = {True: Counter(), False: Counter()}
    text = lambda u: "\x02" * k + re.sub(r"(?s)^.*?://", "", u or "") + "\x03"
    for u, good in train:
        t = text(u)
        for i in range(k, len(t)):
            for n in range(k + 1):
                grams[good][t[i - n : i + 1], "gram"] += 1
                grams[good][t[i - n : i], "context"] += 1
    for u in tests:
        t, total = text(u), 0.0
        for i in range(k, len(t)):
            p = {}
            for good in (True, False):
                p[good] = 1 / urls.SYMBOLS
                for n in range(k + 1):
                    p[good] = (grams[good][t[i - n : i + 1], "gram"] + urls.PRIOR * p[good]) / (grams[good][t[i - n : i], "context"] + urls.PRIOR)
            total += math.log(p[True] / p[False])
        assert found[u] == pytest.approx(total / (len(t) - k), abs=1e-9)
    assert found["http://q.r/good"] > 0 > found["http://q.r/bad"]


def test_url_threshold(spark):
    rows_ = [(s / 10, True) for s in range(2, 20)] + [(-s / 10, False) for s in range(2, 20)]
    cut = urls.threshold(spark.createDataFrame(rows_, "score double, accepted boolean"))
    assert -0.2 < cut <= 0.2
    assert urls.threshold(spark.createDataFrame([(1.0, True)], "score double, accepted boolean")) == 0.0


def fold(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


def test_base_scores(spark, case, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD_WORDS", 50)  # so that most words are joined
    path, docs = case
    tokens = lambda t: WORD.findall(lower(t)) + ["\n"]
    counts = Counter(w for d, t in docs if fold(d, 7) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for d, t in docs:
        own = tokens(t)
        want[d, fold(d, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n].append(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    found = defaultdict(list)
    both = []
    for r in rows(spark, "op7_suffix_tree_scores", path):
        found[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]].append(r["base_score"])
        assert r["score"] <= 0
        both.append((r["held_out"], r["score"], r["base_score"]))
    assert found.keys() == want.keys()
    for k in want:
        assert sorted(found[k]) == pytest.approx(sorted(want[k]), rel=1e-9)
    if len(both) > 100:  # the tree beats the counts on texts that neither has seen
        assert sum(s for h, s, _ in both if h) > sum(b for h, _, b in both if h)


def test_tree_uses_contexts(spark, monkeypatch):
    """A word that follows another in the training texts gains by it; any context and unknown words have finite scores."""
    for name, value in (("HOT", 100), ("DIVERGENCE", 1.0)):
        monkeypatch.setattr(suffix_tree, name, value)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(300):
        line = [rng.choice(words)]
        for _ in range(20):
            line.append(words[(words.index(line[-1]) * 3 + int(rng.integers(2))) % 40] if rng.random() < 0.8 else str(rng.choice(words)))
        texts.append(" ".join(line))
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    contexts = ["", "w3", "w5 w15", "w1 w3 w9", "zzz w7", "w2 zzz"]
    tails = [*words, "never", None]
    ask = [(i * 100 + j, " ".join([*c.split(), *([t] if t else [])])) for i, c in enumerate(contexts) for j, t in enumerate(tails)]
    asked = spark.createDataFrame(ask, "doc_id long, text string")
    found = {r.doc_id: r.score for r in suffix_tree.scored(asked, train).collect()}
    assert all(math.isfinite(s) and s < 0 for s in found.values())
    pairs = spark.createDataFrame([(1, "w5 w15"), (2, "w5 w30"), (3, "w15"), (4, "w30")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in suffix_tree.scored(pairs, train).collect()}
    assert s[1] - s[2] > s[3] - s[4] + 0.5  # w15 follows w5 in the training texts, w30 does not


class PlainTree:
    """The suffix tree from its definition, over dictionaries."""

    def __init__(self, texts, divergence, prior, least=2, context=8, depth=3):
        lists = [["\t", *t.split(), "\n"] for t in texts]
        self.n = Counter(tuple(t[i : i + k]) for t in lists for k in range(1, depth + 2) for i in range(len(t) - k + 1))
        self.after = defaultdict(list)
        for run, n in self.n.items():
            if len(run) > 1 and n >= least:
                self.after[run[:-1]].append(run[-1])
        ones = {r[0]: n for r, n in self.n.items() if len(r) == 1 and r != ("\t",)}
        self.total, self.discount = sum(ones.values()), min(0.9, max(sum(n == 1 for n in ones.values()), 1) / len(ones))
        self.unknown = self.discount * len(ones) / self.total
        self.prior, self.depth = prior, depth
        self.back = {}  # contexts that stay: what they leave for other words, and those that do not: None
        for size in range(1, depth + 1):
            for c, words in self.after.items():
                if len(c) == size and self.n[c] >= context:
                    of, n = self.n[c], [self.n[(*c, w)] for w in words]
                    q = [self.chance(c[1:], w) for w in words]
                    rest_n, rest_q = max(of - sum(n), 0), max(1 - sum(q), 1e-9)
                    gain = sum(a * math.log(a / of / b) for a, b in zip(n, q)) + (rest_n * math.log(rest_n / of / rest_q) if rest_n else 0)
                    if gain >= divergence:
                        self.back[c] = (rest_n + prior * rest_q) / (of + prior) / rest_q

    def chance(self, c, w):
        if not c:
            return max(self.n[(w,)] - self.discount, 1e-9) / self.total if self.n[(w,)] else self.unknown
        q = self.chance(c[1:], w)
        if c not in self.back:
            return q
        return (self.n[(*c, w)] + self.prior * q) / (self.n[c] + self.prior) if w in self.after[c] else q * self.back[c]

    def score(self, text):
        t = ["\t", *text.split(), "\n"]
        return sum(math.log10(self.chance(tuple(t[max(0, i - self.depth) : i]), t[i])) for i in range(1, len(t)))


def test_tree_equals_its_definition(spark, monkeypatch):
    """Rare phrases are scored by their contexts whatever HOT is; contexts below the least count are none."""
    monkeypatch.setattr(suffix_tree, "DIVERGENCE", 2.0)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(200)] + ["rare fox jumps over it " + str(rng.choice(words)) for _ in range(8)] + ["seldom seen again"] * 7
    asked = [*texts[::7], "a rare fox jumps over it", "fox jumps never", "rare w1 w2 it", "seldom seen again", "", None]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    tree = PlainTree(texts, 2.0, suffix_tree.PRIOR)
    assert any(len(c) == 3 for c in tree.back) and ("seldom",) not in tree.back
    want = [tree.score(t or "") for t in asked]
    for hot, head_words in ((1 << 19, 100_000), (20, 10)):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        monkeypatch.setattr(suffix_tree, "HEAD_WORDS", head_words)
        found = {r.doc_id: r.score for r in suffix_tree.scored(docs, train).collect()}
        assert [found[i] for i in range(len(asked))] == pytest.approx(want, rel=1e-9)
    for before in ((), ("rare",), ("w1",), ("rare", "fox", "jumps")):
        assert sum(tree.chance(before, w) for (w,) in [r for r in tree.n if len(r) == 1 and r != ("\t",)]) + tree.chance(before, "never") == pytest.approx(1.0, abs=1e-6)



def test_bpe(spark, case):
    path, docs = case
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(file), special_tokens={})
    want = Counter()
    for d, t in docs:
        ids = encoder.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    found = rows(spark, "op8_byte_level_bpe", path)
    assert multiset(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_mixtures():
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(file), special_tokens={})
    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'S", "'re", "'ve", "'ll", "'l", "'t", "'d", "a", "B", "é", "1", "²", "!", "?", "\x85", "　", "\x1c", "́", "日本", "😀", "\x00", "\r\n", "<|endoftext|>", "s", "x" * 50, "the "]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(3000)] + ["ab" * 5000, " " * 5000]
    ids = byte_bpe.encode_texts([t.encode() for t in texts], file)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [encoder.encode_ordinary(t) for t in texts]
    for t, x in zip(texts, ids):
        assert byte_bpe.decode_ids(x, file) == t.encode()
        at = byte_bpe.token_offsets(x, file)
        assert at[-1] == len(t.encode()) and b"".join(byte_bpe.decode_ids(x[4 * k : 4 * k + 4], file) for k in range(len(x) // 4)) == t.encode()
    with pytest.raises(ValueError):
        byte_bpe.decode_ids(np.array([50256], "<u4").tobytes(), file)


def test_token_files(spark, case):
    path, docs = case
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in docs]
    found = rows(spark, "op10_token_id_output", path)
    assert multiset(found, "doc_id", "n_tokens", "ids_crc32") == Counter((d, len(b) // 4, zlib.crc32(b)) for d, b in coded)
    found.sort(key=lambda r: r["start"])
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)


def test_code_lengths_are_optimal_within_the_limit():
    import heapq

    rng = np.random.default_rng(2)
    for n, limit in ((2, 20), (7, 20), (300, 20), (300, 9), (40, 6), (1, 20), (0, 20)):
        counts = (rng.pareto(0.6, n) * 10 + 1).astype(np.int64)
        lengths = huffman_ids.code_lengths(counts, limit)
        assert (lengths <= limit).all()
        if n > 1:
            assert sum(2.0 ** -int(x) for x in lengths) == pytest.approx(1.0)
        if n > 1 and limit == 20:
            heap = [int(c) for c in counts]
            heapq.heapify(heap)
            cost = 0
            while len(heap) > 1:
                two = heapq.heappop(heap) + heapq.heappop(heap)
                cost += two
                heapq.heappush(heap, two)
            free = int((lengths.astype(int) * counts).sum())
            assert free >= cost and (lengths.max() == limit or free == cost)
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(40, int), 5)


def test_streams_decode_from_every_checkpoint():
    rng = np.random.default_rng(4)
    ids = (rng.pareto(1.0, 5000) * 3).astype(np.int64) % 3000
    book = huffman_ids.Book(huffman_ids.code_lengths(np.bincount(ids)))
    stream, at = book.encode(ids)
    counts = np.minimum(huffman_ids.CHECK, len(ids) - np.arange(len(at)) * huffman_ids.CHECK)
    assert (book.decode(stream, at, counts) == ids).all()
    k = len(at) // 2
    assert (book.decode(stream, at[k : k + 1], counts[k : k + 1]) == ids[k * huffman_ids.CHECK :][: counts[k]]).all()
    assert book.encode(np.zeros(0, np.int64))[0] == b""


def test_toxicity_on_held_out_documents(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    found = {r["doc_id"]: r for r in rows(spark, "op6_toxicity", path)}
    assert len(found) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (fold(d, 4) == 2) for d, r in found.items())
    held = [(r.toxic, found[r.doc_id]["predicted"]) for r in spark.read.parquet(f"{path}/labels.parquet").collect() if r.toxic is not None and found[r.doc_id]["held_out"]]
    hits = sum(y and p for y, p in held)
    assert hits >= 0.6 * sum(p for _, p in held) and hits >= 0.5 * sum(y for y, _ in held)


def test_toxicity_odd_rows_and_spans(spark, odd_dir, odd_rows):
    assert Counter(r["doc_id"] for r in rows(spark, "op6_toxicity", odd_dir)) == Counter(d for d, _ in odd_rows)
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(300)]
    line = lambda bad: " ".join([*rng.choice(words, 12), *(["scum,"] if bad else []), *rng.choice(words, 12)])
    texts, marks = zip(*[(line(k % 4 == 0), int(k % 4 == 0)) for k in range(400)])
    field = toxicity.fit([t.encode() for t in texts], list(marks))
    asked = spark.createDataFrame([(1, "Été word3 word5 SCUM! word9 word7"), (2, "word3 word5 word9 word7 word8"), (3, None), (4, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in toxicity.score(asked, field).collect()}
    assert r[1].score > 0.5 > max(r[2].score, r[3].score, r[4].score)
    assert [r[1].text[s.start : s.end] for s in r[1].toxic_spans] == ["SCUM!"]
    assert not r[2].toxic_spans and not r[3].toxic_spans


def test_marginals_match_all_paths():
    rng = np.random.default_rng(8)
    sizes = np.array([4, 0, 1, 6])
    scores, moves = rng.normal(size=11), rng.normal(size=(2, 2))
    sizes_ = sizes[sizes > 0]
    odds = toxicity.forward_backward(scores, sizes_, moves)[2]
    at = 0
    for n in sizes_:
        weight = np.zeros((n, 2))
        for path in range(1 << n):
            y = [(path >> i) & 1 for i in range(n)]
            w = math.exp(sum(scores[at + i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            for i in range(n):
                weight[i, y[i]] += w
        assert odds[at : at + n] == pytest.approx(weight[:, 1] / weight[:, 0])
        at += n


def test_quality_joins_only_marked_texts(spark, monkeypatch):
    """Ids that share a slot with trusted ones are sorted out by the join; the marks miss no trusted id."""
    from pyspark.sql import functions as F

    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "good_id")
    marks = quality.hashed_marks(ids, "good_id", 64).first()["marks"]
    assert len(marks) == 64
    table = quality.hashed_marks(ids, "good_id", 64)
    hit = {r.id for r in spark.range(6000).where(quality.is_marked(F.col("id"), table.scalar(), 64)).collect()}
    assert set(range(0, 3000, 3)) <= hit and len(hit) < 3000
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(30))) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 4)], "doc_id long, quality int")
    few = {r.doc_id: (r.score, r.kept) for r in quality.judged(docs, labels).collect()}
    monkeypatch.setattr(quality.hashed_marks, "__defaults__", (1,))
    monkeypatch.setattr(quality.is_marked, "__defaults__", (1,))
    assert {r.doc_id: (r.score, r.kept) for r in quality.judged(docs, labels).collect()} == few
