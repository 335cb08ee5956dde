"""Streaming jobs run to completion over the event table; their results equal the batch SQL."""

from __future__ import annotations

from placeloom.streaming import engagement as live

Q: dict = {}
SQL: dict[str, str] = {}


def events(spark, d):
    return live.stream(spark, f"{d}/events.parquet")


def t01(spark, d):
    return live.live_counters(events(spark, d), "user_id", "event_type")


def t02(spark, d):
    return live.accepted_events(events(spark, d)).select("event_id", "user_id", "event_type")


def t04(spark, d):
    return live.sliding_counts(events(spark, d))


def t06(spark, d):
    return live.hourly_load(events(spark, d), "event_type")


Q |= {"t01_live_counters": t01, "t02_accepted_events": t02, "t04_sliding_counts": t04, "t06_hourly_load": t06}
SQL |= {
    "t01_live_counters": "SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "t04_sliding_counts": "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 13 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY 1, 2",
    "t06_hourly_load": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
