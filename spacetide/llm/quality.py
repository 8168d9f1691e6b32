"""Quality rules: base counts of every document and a hashed n-gram likelihood ratio, all in DataFrame functions.

Word unigrams and bigrams are hashed into fixed buckets. Two multinomials over the buckets are
counted: documents that a label trusts, and the raw corpus. A document's score is the mean of
log p_trusted - log p_raw over its n-grams; documents below one threshold, set from trusted documents that the trusted
counts have not seen, are rejected. Scoring needs no shuffle: the weights are one array of fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordered_counts
from ..session import cut_lineage
from .text import SPACES, ascii_lower, fold, fresh, split_words, without

#: Buckets for unigrams and as many for bigrams; added to each bucket's count (raw counts scaled to the trusted total).
BUCKETS, ADDED = 1 << 14, 4.0
#: One trusted document in so many sets the threshold and is not counted as trusted text.
HELD_OUT = 5
#: Share of the held-out trusted documents that lies below the threshold.
LOST = 0.005
#: Longs of 64 slots each that say which hashed ids may be trusted: 2^24 slots, 2 MB whatever the number of ids.
MARKS = 1 << 18
#: Fixed values of the base rules: fewest words, highest percentage of words in repeated windows, words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8


def with_base(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``docs`` plus words (array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, named by ``names``.

    Null texts count as empty. A window is found twice if two places of the text have equal words, overlapping or not.
    """
    words, n_words, chars, symbols, lines, repeated, failed = names
    hashes, order, places, kept = fresh(docs, *[f"{x}_{n_words}" for x in ("hashes", "order", "places", "kept")])
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({words: split_words(F.col(text)), kept: F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    n = F.size(words)
    df = df.withColumn(hashes, F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))))
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(order, F.when(twice, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(k: Column, j: Column) -> Column:
        return F.coalesce(F.get(order, k)["h"] == F.get(order, j)["h"], F.lit(False))

    df = df.withColumn(places, F.array_sort(F.transform(F.filter(order, lambda _, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"])))
    steps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    df = df.withColumns(
        {
            n_words: n.cast("long"),
            chars: F.length(F.array_join(words, "")).cast("long"),
            symbols: F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
            lines: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"),
            repeated: F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    df = df.withColumn(failed, (F.col(n_words) < LEAST_WORDS) | (100 * F.col(repeated) > MOST_REPEATED * F.col(n_words)))
    return df.drop(hashes, order, places, kept)


def _one(first: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(first), F.lit(buckets)).cast("int")


def _two(first: Column, second: Column, buckets: int) -> Column:
    return (F.pmod(F.xxhash64(first, second), F.lit(buckets)) + buckets).cast("int")


def gram_counts(docs: DataFrame, trusted: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, trusted)`` over all n-grams of all documents; at most 2 * buckets rows, combined before the shuffle."""
    lower = docs.select(split_words(ascii_lower(F.col(text))).alias("w"), F.coalesce(trusted, F.lit(False)).cast("int").alias("t"))
    pairs = lower.select("t", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("g"))
    pairs = pairs.select("t", F.col("g")["a"].alias("a"), F.col("g")["b"].alias("b"))
    grams = pairs.select("t", F.explode(F.array(_one(F.col("a"), buckets), F.when(F.col("b").isNotNull(), _two(F.col("a"), F.col("b"), buckets)))).alias("bucket"))
    return grams.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))


def hashed_marks(ids: DataFrame, name: str, longs: int = MARKS) -> DataFrame:
    """One row: an array of ``longs`` longs in which the slot of every id is set."""
    slot = F.pmod(F.xxhash64(name), F.lit(64 * longs))
    words = ids.groupBy(F.floor(slot / 64).cast("int").alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("v"))
    every = ids.sparkSession.range(longs).select(F.col("id").cast("int").alias("k")).join(words, "k", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit(0)).alias("v")))), lambda x: x["v"]).alias("marks"))


def is_marked(doc_id: Column, marks: Column, longs: int = MARKS) -> Column:
    """Whether the id's slot is set: true for every marked id and for few others."""
    slot = F.pmod(F.xxhash64(doc_id), F.lit(64 * longs))
    return F.getbit(F.get(marks, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1


def weights(counts: DataFrame, buckets: int = BUCKETS, added: float = ADDED) -> DataFrame:
    """One row: the array of log p_trusted - log p_raw by bucket, of fixed length 2 * buckets (0 where nothing was counted)."""
    spark = counts.sparkSession
    scaled = F.col("raw") * counts.agg(F.sum("trusted") / F.sum("raw")).scalar()
    known = counts.select("bucket", F.log((F.col("trusted") + added) / (scaled + added)).alias("v"))
    every = spark.range(2 * buckets).select(F.col("id").cast("int").alias("bucket")).join(known, "bucket", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda x: x["v"].cast("float")).alias("w"))


def mean_ratio(words: str, table: Column, buckets: int = BUCKETS) -> Column:
    """Mean weight of a word array's n-grams; 0 for no words."""
    n = F.size(words)
    pick = lambda k: F.get(words, k)
    add = lambda acc, k: acc + F.get(table, _one(pick(k), buckets)) + F.when(k + 1 < n, F.get(table, _two(pick(k), pick(k + 1), buckets))).otherwise(0.0)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)
    return F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept (named with ``prefix``; columns of these names are replaced).

    ``labels``: (doc_id, quality); a document is trusted if any of its labels has quality 1; all of them count. Only texts whose
    hashed id is marked meet the trusted ids in a shuffle join, at every size. The raw counts cover all documents. ``kept``: not
    base_failed and score at least the threshold (no threshold, so nothing more rejected, where no trusted document is held
    out). Null texts are empty and fail the base rules; repeated rows are judged alike; null ids are never trusted.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = without(docs, [prefix + n for n in names], text)
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct()
    kind = docs.schema[doc_id].dataType
    good = cut_lineage(good.select(F.col("good_id").cast(kind)), "trusted")
    marks = cut_lineage(hashed_marks(good, "good_id"), "marks")
    plain = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    maybe = F.coalesce(is_marked(F.col("i"), marks.scalar()) & F.col("i").isNotNull(), F.lit(False))
    held = fold(F.col("i"), HELD_OUT) == 0
    met = lambda some: some.join(good.hint("merge"), F.col("i") == F.col("good_id"), "left")
    counted = met(plain.filter(maybe & ~held)).select("t", F.col("good_id").isNotNull().alias("trusted"))
    counted = plain.filter(~(maybe & ~held)).select("t", F.lit(False).alias("trusted")).unionByName(counted)
    counts = cut_lineage(gram_counts(counted, F.col("trusted"), "t"), "grams")
    table = cut_lineage(weights(counts), "weights")

    def scored(df: DataFrame, words: str, out: str) -> DataFrame:
        """The weights are a value of the plan: one array of fixed length, read once a stage and laid beside each row."""
        low, at = fresh(df, "lower_" + words, "weights_" + words)
        lowered = df.withColumns({low: F.transform(words, ascii_lower), at: table.scalar()})
        return lowered.withColumn(out, mean_ratio(low, F.col(at))).drop(low, at)

    sure = met(plain.filter(maybe & held)).filter(F.col("good_id").isNotNull()).select(split_words(F.col("t")).alias("w"))
    ranks = ordered_counts(cut_lineage(scored(sure, "w", "score").select("score"), "threshold"), "score")
    cut = ranks.filter(F.col("cum_before") + F.col("cnt") >= F.ceil(F.col("total") * F.lit(LOST))).agg(F.min("score").alias("least")).first()["least"]
    words = fresh(docs, "words")[0]
    df = scored(with_base(docs, text, [words, *[prefix + n for n in names[:6]]]), words, prefix + "score").drop(words)
    passed = F.lit(True) if cut is None else F.col(prefix + "score") >= F.lit(cut)
    return df.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & passed)


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they were."""
    prefix = "judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    # the row number keeps the filter above the projections: pushed down, it would repeat their expressions many times over
    found = judged(docs, labels, doc_id, text, prefix).withColumn(prefix + "row", F.monotonically_increasing_id())
    return found.filter(F.col(prefix + "kept") & (F.col(prefix + "row") >= 0)).select(*docs.columns)
