"""Streams with state over several micro-batches: late rows, merged runs, updated cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spacetide.streaming import streams as S

SCHEMA = "k string, ts timestamp, value double"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture()
def arrive(spark, tmp_path):
    """Write batches of rows as files that arrive one after the other."""

    def make(*batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        return S.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)

    return make


#: The first row moves the clock, the batch with the second one gives out what that closed.
END = [(None, at(400), None)]
END2 = [(None, at(401), None)]


def test_windows_close_once_and_drop_late_rows(arrive):
    first = [("a", at(0, 1), 1.0), ("a", at(0, 5), 3.0)]
    second = [("a", at(1, 2), 10.0), ("a", at(0, 23), 5.0)]  # the second row is late but within the lateness
    third = [("a", at(5), 7.0)]
    fourth = [("a", at(5, 1), 9.0)]
    fifth = [("a", at(0, 2), 100.0)]  # comes after its window was given out
    out = S.drain(S.stream_window_means(arrive(first, second, third, fourth, fifth, END, END2), "ts", "1 day", by=["k"]), "w").where("k is not null")  # not before: the filter would hide the closing rows from the clock
    got = {r.window_start.date().day - 1: (r.value, r.n) for r in out.collect()}
    assert got == {0: (3.0, 3), 1: (10.0, 1), 5: (8.0, 2)}


def test_late_row_merges_two_runs(arrive):
    first = [("a", at(0), 1.0), ("a", at(2), 1.0), ("b", at(0), 1.0)]
    second = [("a", at(1), 1.0), ("b", at(3), 1.0)]  # a's second day arrives after the days around it
    third = [("a", at(20), 1.0)]
    fourth = [("b", at(20), 1.0)]
    fifth = [("a", at(1, 12), 1.0)]  # too late: its run has been given out
    events = S.stream_events(arrive(first, second, third, fourth, fifth, END, END2), "ts", ["k"], lateness="2 days")
    rows = S.drain(events, "runs").where("k is not null").collect()
    got = sorted((r.k, r.start.date().day - 1, r.end.date().day - 1, r.n_active) for r in rows)
    assert got == [("a", 0, 2, 3), ("a", 20, 20, 1), ("b", 0, 0, 1), ("b", 3, 3, 1), ("b", 20, 20, 1)]


def test_updated_cells_equal_the_batch(spark, arrive):
    batches = [[(f"c{i % 3}", at(i), float(i * j)) for i in range(6)] for j in range(1, 5)]
    out = S.drain(S.stream_cube_stats(arrive(*batches), by=["k"]), "cells", "update", ["k"])
    whole = S.stream_cube_stats(spark.createDataFrame(sum(batches, []), SCHEMA), by=["k"])
    key = lambda df: sorted((r.k, r.n, round(r.mean, 9), round(r.variance, 9)) for r in df.collect())
    assert key(out) == key(whole)
    with pytest.raises(ValueError):
        S.drain(S.stream_cube_stats(arrive(), by=["k"]), "cells", "complete")


def test_replay_keeps_every_row(spark):
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(10)], SCHEMA)
    root = S.replay(df, "ts", 3)
    back = spark.read.parquet(root)
    assert back.where("k is not null").count() == 10 and back.where("k is null").count() == 2
    assert sorted(back.where("k is not null").groupBy("part").count().select("count").collect()) and back.select("part").distinct().count() == 5
    assert spark.read.schema(df.schema).parquet(S.replay(df.where(F.lit(False)), "ts")).count() == 0
