"""The registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, huffman_ids, packing, prefix_trie, quality, secret_scan, shards, simhash, suffix_tree, toxicity, urls, whitening
from .text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_simhash_near_dedup")
def _(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


_OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i + 1:i + least(13, len(w))], ' ') AS k
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
seen AS (
  SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM seen JOIN windows USING (n, k)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""


@query("op5_benchmark_decontamination", _OP5_SQL)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_byte_level_bpe")
def _(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    read = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded", keep_text=False)
    return read.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_quality_rules")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels")).drop("text")


#: The rules by host and path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_url_filters")
def _(spark, sf_dir):
    found = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op3_sharding")
def _(spark, sf_dir):
    found = shards.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


@query("op7_suffix_tree_scores")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    found = suffix_tree.scored(docs.withColumn("held_out", held), docs.filter(~held), columns=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_secret_scans")
def _(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[secret_scan.counted(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(named(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        secret_scan.counted("random").alias("n_random"),
    )


@query("op6_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    field = toxicity.fit(*toxicity.training_sample(docs.filter(~held), table(spark, sf_dir, "labels")))
    found = toxicity.score(docs.withColumn("held_out", held), field, keep_text=False)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_toxic_spans"))


@query("op10_token_id_output")
def _(spark, sf_dir):
    found = huffman_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, c - c % 5 AS b,
    xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, y: xor(t[xor(a % 256, y) + 1], a >> 8), 4294967295::BIGINT)) % 9 AS h
  FROM own, crc),
lent AS (SELECT v.c, v.h, count(o.c) AS n FROM convs v LEFT JOIN own o ON o.c = v.b AND o.p <= v.h GROUP BY ALL),
rebuilt AS (
  SELECT v.c, o.p AS d, o.r, o.x FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h
  UNION ALL
  SELECT l.c, l.n + o.p - l.h, o.r, o.x FROM lent l JOIN own o ON o.c = l.c AND o.p > l.h),
prefixes AS (
  SELECT c, d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS k, strlen(x) AS z FROM rebuilt
  UNION ALL
  SELECT c, 0, [], 0 FROM convs),
turns AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
nodes AS (
  SELECT k, d, min(c) AS conv, count(*) AS n_convs, any_value(z) AS z, list_sort(list(c) FILTER (d = n)) AS ends
  FROM prefixes JOIN turns USING (c) GROUP BY k, d),
members AS (SELECT p.c, n.* FROM nodes n JOIN prefixes p USING (k)),
parents AS (SELECT n.conv, n.d, m.conv AS parent FROM nodes n JOIN members m ON m.c = n.conv AND m.d = n.d - 1),
children AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n FROM parents GROUP BY ALL),
below AS (SELECT DISTINCT a.conv, a.d, m.conv AS low_conv, m.d AS low_d, (m.n_convs - 1) * m.z AS saved FROM members a JOIN members m ON m.c = a.c AND m.d >= a.d),
sums AS (
  SELECT b.conv, b.d, count(*) FILTER (x.n IS NULL) AS n_leaves, sum(b.saved) AS saved
  FROM below b LEFT JOIN children x ON x.conv = b.low_conv AND x.d = b.low_d GROUP BY ALL)
SELECT n.conv::BIGINT AS conv_id, n.d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(x.n, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(ends, ','), '')) AS ends_sha256
FROM nodes n JOIN sums USING (conv, d) LEFT JOIN parents USING (conv, d) LEFT JOIN children x ON x.conv = n.conv AND x.d = n.d"""


@query("op11_conversation_prefix_trie", _OP11_SQL)
def _(spark, sf_dir):
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 5, head=lambda c: crc(c) % 9, most=8)


@query("op12_embedding_whitening")
def _(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip(F.col("whitened"), F.col("explained"))).alias("i", "c")
    rows = found.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


@query("op13_packing")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), checksums=True)
