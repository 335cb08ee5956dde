from placeloom.streaming import engagement as live


def events(spark, tmp_path, rows):
    path = str(tmp_path / "events.parquet")
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type")
    df.repartition(3).write.parquet(path)
    return live.stream(spark, path)


def test_window_from_last_accepted(spark, tmp_path):
    at = ["10:00:00", "10:00:50", "10:01:10", "10:01:40", "10:02:11", "10:02:11"]
    rows = [(i, f"2024-01-01 {t}", 1, "view") for i, t in enumerate(at)] + [(10, "2024-01-01 10:00:01", 2, "view"), (11, "2024-01-01 10:00:02", 1, "click"), (12, None, 1, "view")]
    got = sorted(r.event_id for r in live.accepted_events(events(spark, tmp_path, rows)).collect())
    assert got == [0, 2, 4, 10, 11]


def test_counters_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 10:{i % 60:02d}:00", i % 3 or None, "view" if i % 2 else "click") for i in range(90)]
    s = events(spark, tmp_path, rows)
    got = {(r.user_id, r.event_type): r.n for r in live.live_counters(s, "user_id", "event_type").collect()}
    want = {}
    for _, _, u, k in rows:
        if u is not None:
            want[u, k] = want.get((u, k), 0) + 1
    assert got == want
