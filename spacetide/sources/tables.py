"""Event, slice and trait tables: reading, harmonising, flagging, sampling, writing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing
from ..session import cut_lineage

# Names under which the same attribute arrives: fixed values of the input formats.
ALIASES = {
    "event_id": ["event_id", "id", "fire_id"],
    "date": ["date", "timestamp", "observed_at"],
    "final_area_km2": ["final_area_km2", "tot_ar_km2", "total_area_km2"],
    "daily_area_km2": ["daily_area_km2", "dy_ar_km2", "ring_area_km2"],
    "duration_days": ["duration_days", "event_dur"],
}


def harmonise(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """First present alias becomes the canonical column; several present ones are coalesced."""
    lower = {c.lower(): c for c in df.columns}
    used, cols = set(), []
    for name, names in aliases.items():
        found = [lower[n.lower()] for n in names if n.lower() in lower]
        if found:
            cols.append(F.coalesce(*[F.col(c) for c in found]).alias(name))
            used.update(found)
    return df.select(*cols, *[c for c in df.columns if c not in used])


def read_event_tables(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Daily or event table from parquet / csv / json with an explicit schema."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return harmonise(reader.load(path))


def project_slices(traits: DataFrame) -> DataFrame:
    """Trait columns needed for analysis, with days instead of hours."""
    return traits.select(
        "fire_id",
        "year",
        "region",
        "total_area_km2",
        (F.col("duration_hours") / 24.0).alias("duration_days"),
        (F.col("peak_growth_km2_per_hour") * 24.0).alias("peak_growth_km2_per_day"),
    )


def _text_columns(df: DataFrame, key: str) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c != key]


def _attribute_hits(df: DataFrame, key: str, pattern: str | None, values: Iterable | None, column: str | None) -> DataFrame:
    cols = [column] if column else _text_columns(df, key)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    kinds = dict(df.dtypes)
    # one pass over the wide rows; only hits are expanded
    hits = []
    for c in cols:
        text = F.col(c).cast("string")
        if values is not None:
            hit, seen = text.isin(*[str(v) for v in values]), text
        elif kinds[c] == "boolean":
            hit, seen = F.col(c), F.lit("True")
        else:
            hit, seen = text.rlike(f"(?i){pattern}"), text
        hits.append(F.when(C.is_true(hit), F.struct(F.lit(c).alias("column_name"), seen.alias("value"))))
    return df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "h.*")


def attribute_matches(df: DataFrame, key: str, *, pattern: str | None = None, values=None, column: str | None = None) -> DataFrame:
    """Rows with evidence in any text attribute (regex, given values, or a true flag)."""
    ids = _attribute_hits(df, key, pattern, values, column).select(key).distinct()
    return df.join(ids, key, "left_semi")


def attribute_evidence(df: DataFrame, key: str, *, pattern: str | None = None, values=None, column: str | None = None, keep: int = 20) -> DataFrame:
    """Per column: matching events and the first ``keep`` distinct values in order."""
    hits = _attribute_hits(df, key, pattern, values, column)
    counted = hits.groupBy("column_name").agg(F.countDistinct(key).alias("n_events"))
    # distinct first, then a rank filter Spark can push below the shuffle
    first = hits.select("column_name", "value").distinct().withColumn(
        "_r", F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    )
    shown = first.where(F.col("_r") <= keep).groupBy("column_name").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("evidence")
    )
    return counted.join(shown, "column_name")


WIND_PRESENT_M_S = 0.1
MISSING_CLIMATE = "outside_gridmet_coverage_or_missing_value"


def climate_flags(df: DataFrame, cols: Sequence[str], wind: str = "wind_speed_m_s") -> DataFrame:
    ok = C.all_present(cols)
    return df.withColumns(
        {
            "wind_present": C.is_true(F.col(wind) > WIND_PRESENT_M_S),
            "climate_available": ok,
            "climate_failure_reason": F.when(~ok, F.lit(MISSING_CLIMATE)),
        }
    )


def panel_selection(spans: DataFrame, *, min_days: int, max_days: int, max_events: int) -> DataFrame:
    days = F.datediff("t1", "t0") + 1
    return spans.where(days.between(min_days, max_days)).orderBy("t0", "fire_id").limit(max_events)


def longest_in_box(events: DataFrame, *, box, pattern: str, min_days: int, max_days: int, attribute: str = "cause") -> DataFrame:
    """Longest event meeting the box and the attribute pattern; the box alone if nothing matches."""
    x0, y0, x1, y1 = box
    meets = (F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)
    inside = events.where(meets).withColumn("_hit", C.is_true(F.col(attribute).rlike(f"(?i){pattern}")))
    any_hit = inside.agg(F.coalesce(F.bool_or("_hit"), F.lit(False))).scalar()
    kept = inside.where(F.col("_hit") | ~any_hit).where(F.col("days").between(min_days, max_days))
    return kept.orderBy(F.desc("days"), "t0", "fire_id").limit(1).drop("_hit")


def drop_consecutive_duplicates(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    previous = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    first = F.lag(F.lit(1)).over(W.partitionBy(key).orderBy(*order)).isNull()
    return df.withColumn("_keep", first | ~F.col(value).eqNullSafe(previous)).where("_keep").drop("_keep")


# --- sampling ----------------------------------------------------------------


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """Equal take per stratum, topped up from the rest to ``n``; all rows when n >= rows.

    The order is a hash of the key, so the draw is the same on any cluster. The
    rank filter has a constant bound, which Spark applies before the shuffle.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total, strata = sizes.agg(F.sum("n"), F.count(stratum)).first()  # bounded probe
    if total is None or n >= total:
        return df
    per = max(1, n // max(1, strata))
    order = hashing.hash_order(F.col(key).cast("string"), F.lit(str(seed)))
    marked = df.withColumn("_h", order)
    taken = (
        marked.where(F.col(stratum).isNotNull())
        .withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("_h", key)))
        .where(F.col("_r") <= per)
        .drop("_r")
    )
    rest = marked.join(taken.select(key), key, "left_anti").withColumn("_late", F.lit(1))
    pool = taken.withColumn("_late", F.lit(0)).unionByName(rest)
    return pool.orderBy("_late", "_h", key).limit(n).drop("_late", "_h")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Uniform sample of n rows without replacement (a top-n by hash)."""
    return df.orderBy(hashing.hash_order(F.col(key).cast("string"), F.lit(str(seed))), key).limit(n)


# --- writing and checking ----------------------------------------------------

PARTITIONS = ("year", "region", "spatial_bucket", "processing_version")


def write_table(df: DataFrame, root: str, table: str, *, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write under ``table/year=/region=/spatial_bucket=/processing_version=``.

    Event ids stay in the rows: a partition per event would drown the catalog.
    Rows are clustered by the partition columns first, so each directory gets
    few files; AQE splits a partition value that is too large for one task.
    """
    if "fire_id" in table.lower():
        raise ValueError("a table name must not encode event ids")
    clean = df.withColumn("processing_version", F.regexp_replace("processing_version", "/", "_"))
    by = [c for c in PARTITIONS if c in clean.columns]
    path = f"{root}/{table}"
    clean.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt).save(path)
    return path


_BOM = b"\xef\xbb\xbf"
#: Files that the reader of lines would decompress.
_PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|lzo|xz)$"


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and sha256 of files given as (path, size, bytes between line feeds), one file after the other.

    The reader of lines leaves out a byte-order mark and does not say whether the last line ends in a line feed; the size tells both.
    """
    path, size, first, done = None, 0, [], 0
    plain = marked = None

    def ended() -> pa.RecordBatch:
        mark = size - done >= len(_BOM)
        digest = marked if mark else plain
        digest.update(b"\n" * (size - done - len(_BOM) * mark))
        return pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()]})

    for b in batches:
        paths, sizes = b.column(0).dictionary_encode(), b.column(1)
        codes = paths.indices.to_numpy()
        cut = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[: len(codes)].tolist()
        for i, j in zip(cut, [*cut[1:], len(codes)]):
            of = paths.dictionary[int(codes[i])].as_py()
            if of != path:
                if path is not None:
                    yield ended()
                path, size, done, plain, marked = of, sizes[i].as_py(), 0, hashlib.sha256(), hashlib.sha256(_BOM)
                begin = b""
            else:
                begin = b"\n"
            data = begin + b"\n".join(b.column(2).slice(i, j - i).to_pylist())
            done += len(data)
            plain.update(data)
            marked.update(data)
    if path is not None:
        yield ended()


def _streamed_checksums(spark: SparkSession, path: str, glob: str, largest: int) -> DataFrame:
    """path and sha256 of the files that hold a line. SHA-256 is one chain, so a task reads the whole of a file, but holds only some lines of it."""
    at, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).where(~at.rlike(_PACKED))
    whole = F.assert_true(F.col("_metadata.file_block_length") == size, F.lit("a file was cut before it was hashed"))
    lines = files.select(at.alias("path"), F.when(whole.isNull(), size).alias("size"), F.col("value").cast("binary").alias("value"))
    wanted = {"spark.sql.files.maxPartitionBytes": str(largest + 1), "spark.sql.files.minPartitionNum": "1"}  # no file is cut, small ones share a task
    held = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return cut_lineage(lines.mapInArrow(_checksums, "path string, sha256 string"), "checksums")
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def file_inventory(spark: SparkSession, path: str, glob: str = "*", checksums: bool = True) -> DataFrame:
    """file, kind, size and (with ``checksums``) sha256 of every file below ``path``; hashed on the executors while the bytes are read.

    Files are read between line feeds, so a task holds some lines of a file, not all of it; only files with the names of packed ones are read
    whole. Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kinds = [F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind"), F.col("length").alias("size_bytes")]
    if not checksums:
        return files.select(*kinds)
    at = F.col("_metadata.file_path").alias("_at")
    out = files.select(at, *kinds)
    packed = files.where(at.rlike(_PACKED)).select(at, F.sha2("content", 256).alias("sha256"))
    largest = out.agg(F.max("size_bytes")).first()[0] or 0
    sums = _streamed_checksums(spark, path, glob, largest).withColumnRenamed("path", "_at").unionByName(packed)
    lineless = F.when(F.col("size_bytes") == len(_BOM), hashlib.sha256(_BOM).hexdigest())
    return out.join(sums, "_at", "left").select("file", "kind", "size_bytes", F.coalesce("sha256", lineless).alias("sha256"))


def verify_checksums(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """missing / unexpected / sha256_mismatch / pass per file."""
    a = actual.select("file", F.col("sha256").alias("_a"))
    e = expected.select("file", F.col("sha256").alias("_e"))
    status = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_a") != F.col("_e"), "sha256_mismatch")
        .otherwise("pass")
    )
    return e.join(a, "file", "full").select("file", status.alias("status"))
