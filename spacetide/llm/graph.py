"""Connected components of an edge table as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` longs -> ``(node, root)``, root the smallest node of the component.

    Alternating stars: every neighbour larger than a node is hung on the smallest node known next to it, then every
    node and its smaller neighbours on the smallest of these. A round keeps the number of edges, so a hub never
    multiplies rows; minima combine before they are shuffled, and a hub's side of the join is
    split at run time. Rounds go on until the table stops changing; each is written to the shared folder and
    the one before is deleted. Loops and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    schema = "a long, b long"

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        stage = spark.read.schema(schema).parquet(path)
        mark = stage.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return stage, path, tuple(mark)

    stage, path, mark = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = stage.union(stage.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new, new_path, new_mark = written(small.filter("a <> b").distinct())
        drop_path(spark, path)
        stage, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    return stage.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stage.select("b", "b").distinct())
