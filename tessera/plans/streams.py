"""Queries over the event table: windows in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import ingest


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("event_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    return ingest.tumbling(_events(spark, sf_dir), "1 hour").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sliding", "WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def event_sliding(spark, sf_dir):
    return ingest.sliding(_events(spark, sf_dir), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    got = ingest.sessions(_events(spark, sf_dir), "30 minutes")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("event_rate_windows", """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
w AS (SELECT user_id, min(s) AS start FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.s) FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.start + 3600 GROUP BY 1)
SELECT w.user_id, to_timestamp(start) AT TIME ZONE 'UTC' AS start, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.s >= start AND e.s < start + 3600 GROUP BY 1, 2""")
def event_rate_windows(spark, sf_dir):
    return ingest.rate_windows(_events(spark, sf_dir), 3600, 2).withColumn("start", F.col("start").cast("timestamp_ntz"))
