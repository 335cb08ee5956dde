from datetime import datetime

from placeloom.llm.survivorship import golden_records, survivors

SCHEMA = "id long, group_id long, source string, name string, city string, photo_url string, updated_at timestamp, field string, votes double, best string"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def tables(spark, rows):
    trust = spark.createDataFrame([("google", 1), ("bizdata", 3)], "source string, trust_rank long")
    return spark.createDataFrame([(*r, "x", 0.0, "y") for r in rows], SCHEMA), trust


def test_order_of_trust_date_and_id(spark):
    rows = [
        (-1, 1, "bizdata", "A", "Milltown", "https://x.example/p/1.jpg", T[5]), (-2, 1, " GOOGLE ", "B", "?", "https://x.example/p/default.png", T[1]), (-3, 1, "google", "C", None, "", T[2]),
        (-4, 2, None, "D", "Milltown", None, None), (-5, 2, "other", "E", "Milltown", None, T[0]), (-6, 3, "google", "N/A", "00000", "http://", T[0]),
        (-7, 4, "google", "F", "X1", None, T[3]), (-8, 4, "google", "G", "X2", None, T[3]), (-8, 4, "google", "G", "X2", None, T[3]), (None, 4, "google", "H", "", None, T[8]), (-9, None, "google", "I", "", None, T[8]),
    ]
    got = {(r.group_id, r.field): r.id for r in survivors(*tables(spark, rows)).collect()}
    assert got == {(1, "name"): -3, (1, "city"): -1, (1, "photo_url"): -1, (2, "name"): -5, (2, "city"): -5, (4, "name"): -8, (4, "city"): -8}


def test_votes_and_pivot(spark):
    rows = [(-1, 1, "google", "Alpha", "Milltown", None, T[0]), (-2, 1, "bizdata", "beta", "Milltown", None, T[0]), (-3, 1, "bizdata", "Beta!", "Milltown", None, T[0]), (-4, 1, "bizdata", "BETA", "Milltown", None, T[0]), (-5, 2, "google", "", "", "", None)]
    got = {r.group_id: r.asDict() for r in golden_records(*tables(spark, rows)).collect()}
    assert got[1]["name"].lower().startswith("beta") and got[1]["photo_url"] is None
    assert got[2]["name"] is None and len(got) == 2


def test_older_votes_lose(spark):
    old, new = datetime(2025, 1, 10), datetime(2026, 9, 1)
    rows = [
        # two old votes against a new one, the same without dates, and a group of old votes only
        (-1, 1, "google", "Alpha", None, None, old), (-2, 1, "google", "Alpha", None, None, old), (-3, 1, "google", "Beta", None, None, new),
        (-4, 2, "google", "Alpha", None, None, None), (-5, 2, "google", "Beta", None, None, new),
        (-6, 3, "bizdata", "Alpha", None, None, datetime(2015, 1, 2)), (-7, 3, "bizdata", "Alpha", None, None, datetime(2015, 1, 2)), (-8, 3, "google", "Beta", None, None, datetime(2014, 1, 2)),
    ]
    got = {r.group_id: r["name"] for r in golden_records(*tables(spark, rows)).collect()}
    assert got == {1: "Beta", 2: "Beta", 3: "Alpha"}
    fixed = {r.group_id: r["name"] for r in golden_records(*tables(spark, rows), as_of="2014-01-01").collect()}
    assert fixed[1] == "Alpha"


def test_empty(spark):
    assert survivors(*tables(spark, [])).count() == 0 and golden_records(*tables(spark, [])).count() == 0
