"""The tile-wise reducers as Structured Streaming jobs.

Each function takes and returns a streaming DataFrame; :func:`drain` runs one to
the end of the data that is there now and gives its result as a table in the
shared folder, so a batch and a stream over the same input can be compared.
:func:`replay` lays a table out as files that arrive one after the other.

State lives across micro-batches. Windows and runs of active days are given out
once, when the watermark has passed them (append); a row that comes later than
that is dropped, and one that comes in time joins its window or merges the runs
it lies between. Cell statistics have no end: each batch appends the cells it
changed (update), and the latest row of a cell counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CELL, STD_EPS
from ..session import scratch_path


def file_stream(spark: SparkSession, root: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Arriving parquet files below ``root``."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(root)
    )


def replay(df: DataFrame, time: str, batches: int = 4, name: str = "arrivals", until: str = "366 days") -> str:
    """Write ``df`` as ``batches`` arrivals in the order of ``time`` and two more: one row moves the clock by ``until``, and one, a day later,
    makes the batch in which what that closed is given out; the folder.

    The two rows have no values but their time: they lie in windows of their own, which stay open.
    """
    spark = df.sparkSession
    root = scratch_path(spark, name)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = df.agg(F.min(seconds), F.max(seconds)).first()
    if lo is None:
        df.write.parquet(f"{root}/part=0")
        return root
    edges = [lo + (hi - lo + 1) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        df.where((seconds >= a) & (seconds < b)).write.parquet(f"{root}/part={i}")
    kind = df.schema[time].dataType
    for i in (0, 1):
        late = df.agg(F.max(F.col(time)).alias(time)).withColumn(time, (F.col(time) + F.expr(f"INTERVAL {until}") + F.expr(f"INTERVAL {i} days")).cast(kind))
        late.select(*[F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).coalesce(1).write.parquet(f"{root}/part={batches + i}")
    return root


def arrivals(spark: SparkSession, root: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The files of :func:`replay` in their order, a few in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(root)


def drain(stream: DataFrame, name: str, mode: str = "append", keys=()) -> DataFrame:
    """Run until the available input is used up; return the sink's table.

    append goes to a parquet sink (exactly once); update appends each batch's changed rows under its number, and the latest row
    of each of ``keys`` is the result. A batch that runs again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    if mode != "update":
        raise ValueError("mode must be append or update")
    keys = list(keys)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.option("basePath", path).parquet(path)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("_l"))
    return latest.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def stream_cube_stats(stream: DataFrame, by=CELL, value: str = "value") -> DataFrame:
    """Incremental count, mean and population variance per cell (or per time)."""
    v = F.col(value)
    return stream.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))


def stream_window_means(stream: DataFrame, time: str, size: str, slide: str | None = None, *, lateness: str = "1 day", by=(), value: str = "value") -> DataFrame:
    """Tumbling or hopping means with a watermark for late rows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, lateness).groupBy(w.alias("w"), *by).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "value", "n")


def stream_events(active: DataFrame, time: str, by, *, max_gap_days: int = 0, min_rows: int = 1, lateness: str = "1 day") -> DataFrame:
    """Runs of active rows per key: a session closes after ``max_gap_days`` empty days.

    Identity is (key, start), which does not depend on the order of arrival.
    """
    gap = f"{(max_gap_days + 1) * 86400 + 1} seconds"
    runs = active.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *by).agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n_active")
    )
    return runs.where(F.col("n_active") >= min_rows).select(*by, "start", "end", "n_active")


def stream_zscore(stream: DataFrame, stats: DataFrame, by=CELL, value: str = "value", eps: float = STD_EPS) -> DataFrame:
    """z-score of arriving rows against a static table of cell statistics."""
    s = stats.select(*by, F.col("mean").alias("_m"), F.sqrt("variance").alias("_s"))
    z = F.when(F.col("_s") > eps, (F.col(value) - F.col("_m")) / F.col("_s"))
    return stream.join(s, list(by), "left").withColumn("z", z).drop("_m", "_s")


def stream_ingest(*streams: DataFrame, key: str, time: str, lateness: str = "2 days") -> DataFrame:
    """Tiles or years arriving from several places; rows on shared edges are taken once."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
