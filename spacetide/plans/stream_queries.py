"""Streaming: each query drains a file stream and is compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .inputs import rounded, table
from .registry import query


def _typed(s):
    # event time in the session's zone; only its calendar fields are used below
    return s.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.floor(F.col("user_id") / 10).alias("y_idx"), (F.col("user_id") % 10).alias("x_idx"),
    )


def _stream(spark, d):
    return _typed(S.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet"))


def _arriving(spark, d):
    """The whole table as arrivals in the order of their time, several micro-batches, and the end of time."""
    events = table(spark, d, "events")
    return _typed(S.arrivals(spark, S.replay(events, "ts"), events.schema))


_E = "e AS (SELECT *, CAST(user_id // 10 AS BIGINT) AS y_idx, CAST(user_id % 10 AS BIGINT) AS x_idx FROM events)"


@query(
    "stream_cell_statistics",
    "13.01 4.03",
    f"WITH {_E} SELECT y_idx, x_idx, CAST(count(value) AS BIGINT) AS n, round(avg(value), 8) AS mean, round(var_pop(value), 6) AS variance FROM e GROUP BY ALL",
)
def _(spark, d):
    out = S.drain(S.stream_cube_stats(_arriving(spark, d).where("event_id IS NOT NULL")), "stats", "update", ["y_idx", "x_idx"])
    return rounded(rounded(out, "variance"), "mean", digits=8)


@query(
    "stream_tumbling_means",
    "13.02",
    "SELECT CAST(ts AS DATE) AS day, event_type, round(avg(value), 8) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
)
def _(spark, d):
    out = S.drain(S.stream_window_means(_arriving(spark, d), "ts", "1 day", by=["event_type"]), "tumbling")
    # epoch-aligned day windows start at midnight of the session zone when that zone is UTC
    return rounded(out.select(F.col("window_start").cast("date").alias("day"), "event_type", "value", "n"), "value", digits=8)


@query(
    "stream_hopping_means",
    "13.02",
    """WITH w AS (SELECT CAST(DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 2) * 2 - back AS INTEGER) AS DATE) AS start, value FROM events, (VALUES (0), (2)) o(back))
    SELECT start, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1""",
)
def _(spark, d):
    out = S.drain(S.stream_window_means(_arriving(spark, d), "ts", "4 days", "2 days"), "hopping")
    return rounded(out.select(F.col("window_start").cast("date").alias("start"), "value", "n"), "value")


@query(
    "stream_sessions_of_activity",
    "13.03",
    """WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value >= 30), r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 86401 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a)
    SELECT user_id, CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS "end", CAST(count(*) AS BIGINT) AS n_active FROM r GROUP BY user_id, g HAVING count(*) >= 2""",
)
def _(spark, d):
    active = _arriving(spark, d).where("value >= 30 OR event_id IS NULL")
    out = S.drain(S.stream_events(active, "ts", ["user_id"], max_gap_days=0, min_rows=2), "sessions")
    return out.select("user_id", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "n_active")


@query(
    "stream_zscores",
    "13.04",
    f"WITH {_E}, s AS (SELECT y_idx, x_idx, avg(value) AS m, stddev_pop(value) AS sd FROM e GROUP BY ALL) SELECT event_id, round(CASE WHEN sd > 1e-4 THEN (value - m) / sd END, 6) AS z FROM e JOIN s USING (y_idx, x_idx)",
)
def _(spark, d):
    batch = table(spark, d, "events").select(F.floor(F.col("user_id") / 10).alias("y_idx"), (F.col("user_id") % 10).alias("x_idx"), "value")
    stats = S.stream_cube_stats(batch)
    out = S.drain(S.stream_zscore(_stream(spark, d), stats).select("event_id", "z"), "zscore")
    return rounded(out, "z")


@query("stream_deduplicated_ingest", "13.05", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    both = S.stream_ingest(_stream(spark, d), _stream(spark, d), key="event_id", time="ts", lateness="40 days")
    return S.drain(both.select("event_id", "user_id", "value"), "ingest")
