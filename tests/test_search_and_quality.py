from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placeloom.functions import hours, html, text
from placeloom.operators import quality, search
from placeloom.streaming.engagement import accepted_of


@pytest.mark.parametrize(
    "address, city, state",
    [
        ("12 Oak St, Phoenix, AZ 85004", "Phoenix", "AZ"), ("12 Oak St, Tacoma, WA 98402, USA", "Tacoma", "WA"), ("12 Oak St, Novi, MI", "Novi", "MI"), ("Oak Avenue, 706, Mesa, 85210", "Mesa", None), ("North Drive, 12418, Phoenix", "Phoenix", None),
        ("Rainbow Boulevard, 4316, 66103", None, None), ("1251 River Road", None, None), ("Main St, IN", None, None), ("1 Main St, Springfield, ZZ", None, None), ("", None, None), (None, None, None), (", ,", None, None), ("1 A, X1, NY 10001", None, None),
    ],
)
def test_city_and_state_of_address(spark, address, city, state):
    row = spark.createDataFrame([(address,)], "a string").select(text.city_state_of(F.col("a")).alias("c")).select("c.*").first()
    assert (row.city, row.state) == (city, state)


def test_zips_states_titles(spark):
    rows = [("12 Oak St, Novi, MI 48375-3021", None, "48375"), ("Rainbow Blvd, 43161", "66103", "66103"), ("5 Rainbow Blvd, 43161", None, "43161"), (None, " 12345-6789 ", "12345"), ("x, NY 10001 USA", None, "10001"), ("", "123", None), (None, None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, p string").select(text.zip_of(F.col("a"), F.col("p")).alias("z"))
    assert [r.z for r in df.collect()] == [r[2] for r in rows]
    df = spark.createDataFrame([("NY",), ("new york",), (" Wy ",), ("Ontario",), ("",), (None,)], "s string").select(text.state_code(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["NY", "NY", "WY", None, None, None] and len(text.CODES) == 52
    df = spark.createDataFrame([("  city   OF the  SUN",), ("the dalles",), (" ",), (None,)], "s string").select(text.title_case(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["City of the Sun", "The Dalles", None, None]


R = "id long, name string, city string, state string, phone string, google_rating double, google_review_count int, is_active boolean"


def test_owner_of_copied_ratings(spark):
    areas = spark.createDataFrame([("555", "UT"), ("777", "CA")], "area string, home string")
    rows = [
        # the phone that two share is Utah's, and one of the two is there
        (1, "Blue Oven", "A", "UT", "5550001111", 4.5, 90, True), (2, "Blue Oven", "B", "CA", "5550001111", 4.5, 90, True), (3, "Blue Oven", "C", "CA", "7770001111", 4.5, 90, True),
        # no shared phone: the only local one owns; then none, as two are local; then one city only; then inactive
        (4, "Red Oven", "A", "UT", "5552221111", 4.0, 10, True), (5, "Red Oven", "B", "CA", None, 4.0, 10, True), (6, "Old Oven", "A", "UT", "5552221112", 4.1, None, True), (7, "Old Oven", "B", "CA", "7770001113", 4.1, None, True),
        (8, "Lone Oven", "A", "UT", None, 4.2, 5, True), (9, "Lone Oven", "a ", "UT", None, 4.2, 5, True), (10, "Red Oven", "C", "UT", "5559999999", 4.0, 10, False), (11, None, None, None, None, None, None, None),
    ]
    got = {(r.id, r.detail) for r in quality.copied_ratings(spark.createDataFrame(rows, R), areas).collect()}
    assert got == {(2, "1"), (3, "1"), (5, "4"), (6, None), (7, None)}
    phones = {(r.id, r.detail) for r in quality.copied_phones(spark.createDataFrame(rows, R), areas).collect()}
    assert phones == {(2, "UT")}
    assert quality.copied_ratings(spark.createDataFrame([], R), areas).count() == 0


def test_foreign_states_spare_addresses_at_the_pin(spark):
    rows = [(1, "1 Oak St, Reno, NV 89501", "CA", 39.5, -119.8), (2, "1 Oak St, Reno, NV 89501", "CA", 10.0, 10.0), (3, "1 Oak St, Reno, NV 89501", "Nevada", 10.0, 10.0), (4, None, None, None, None), (5, "1 Oak St, Reno, NV", "CA", 0.0, 0.0)]
    r = spark.createDataFrame(rows, "id long, address string, state string, latitude double, longitude double")
    z = spark.createDataFrame([("89501", 39.53, -119.81)], "zip string, lat double, lng double")
    assert {x.id for x in quality.foreign_state_addresses(r, z).collect()} == {2, 5}


def test_schedule_problems(spark):
    t = lambda h, m=0: datetime(2024, 1, 2, h, m)
    fires = [("hourly", t(1), "done"), ("hourly", t(2), "failed"), ("hourly", t(3, 25), None), ("twice", t(6), "done"), ("twice", t(6, 1), "done"), ("unknown", t(1), "done"), ("hourly", None, "done")]
    f = spark.createDataFrame(fires, "command string, at timestamp, status string")
    g = spark.createDataFrame([("hourly", 60, 0, 30), ("twice", 1440, 360, 30), ("never", 60, 0, 5), ("weekly", 10080, 9000, 5)], "command string, every_minutes int, offset_minutes int, budget_minutes int")
    got = {r.command: r for r in quality.schedule_problems(f, g, "2024-01-02", "2024-01-02 12:00:00").collect()}
    h = got["hourly"]
    assert h.failed and h.hung and h.off_schedule and h.off_schedule_fires == 1 and h.stopped_firing and not h.over_fired
    assert got["twice"].over_fired and not got["twice"].hung and got["never"].never_fired and not got["weekly"].never_fired


def test_search_merge_rules(spark):
    base = "n string, lat double, lng double, slug string, p string, name string, phone string"
    stored = spark.createDataFrame([(1, "a", 1.0, 1.0, "s1", None, "A", None), (2, "b", 2.0, 2.0, "s2", "5550001111", "B", "1")], f"stored_id long, {base}")
    closed = spark.createDataFrame([(9, "z", 9.0, 9.0, "s9", None, "Z", None)], f"stored_id long, {base}")
    live = spark.createDataFrame([(-5, "x", None, None, "s1", "5550001111", "New A", ""), (-4, "b", 2.0, 2.0, "", None, " ", "7"), (-3, "q", 5.0, 5.0, None, None, "Q", None), (-2, "z", 9.0, 9.0, None, None, "Z2", None)], f"live_id long, {base}")
    got = {r.id: (r.live_ids, r.persist, r["name"], r.phone) for r in search.search_merge(stored, live, closed, ["slug", "p"], ["name", "phone"], percent=100.0).collect()}
    # the first stored row wins over a better key, blanks never overwrite, a known closed venue is dropped
    assert got == {1: (1, False, "New A", None), 2: (1, False, "B", "7"), -3: (0, True, "Q", None)}
    assert search.search_merge(stored, live.limit(0), closed, ["slug"], ["name"], percent=100.0).count() == 2


def test_pages_of_a_snapshot(spark):
    rows = spark.range(45).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS popularity_score", "CAST(NULL AS TIMESTAMP) AS updated_at")
    path = search.store_snapshot(rows, "k", search.sort_order("best_match", "2026-01-01"))
    page = search.snapshot_page(spark, path, "k", 3, 20).collect()
    assert len(page) == 5 and {(r.total, r.last_page, r["from"], r.to) for r in page} == {(45, 3, 41, 45)}
    assert search.snapshot_page(spark, path, "other", 1, 20).count() == 0
    assert search.snapshot_page(spark, search.store_snapshot(rows, "k", search.sort_order("x", "2026-01-01"), hours=-1), "k", 1, 20).count() == 0


def test_merging_rows_and_children(spark):
    one = spark.createDataFrame([(2, 1)], "dupe long, keep long")
    two = spark.createDataFrame([(1, 0), (4, 3)], "dupe long, keep long")
    m = search.chained_merges(one, two)
    assert {tuple(r) for r in m.collect()} == {(2, 0, 1), (1, 0, 2), (4, 3, 2)}
    rows = spark.createDataFrame([(0, None, 1), (1, "", 2), (2, "x", None), (3, "k", 5), (4, "z", 6)], "id long, phone string, clicks int")
    assert {tuple(r) for r in search.merged_pairs(rows, m, ["phone"], ["clicks"]).collect()} == {(0, "x", 3), (3, "k", 11)}
    child = spark.createDataFrame([(2, "a"), (0, "a"), (1, "b"), (7, "c"), (None, "d")], "id long, what string")
    assert {tuple(r) for r in search.repointed(child, m, "id").collect()} == {(0, "a"), (0, "b"), (7, "c"), (None, "d")}


def test_field_policy(spark):
    cols = "id long, address string, postal_code string, phone string, photo_url string, google_rating double, google_review_count int"
    stored = spark.createDataFrame([(1, "", "x", None, "http://gps-cs-s/1", 4.0, 10), (2, None, None, "5", "http://a/1", 4.0, 10), (3, None, None, None, None, None, None)], cols)
    inc = spark.createDataFrame([(1, "1 Oak", "y", " ", "http://b/2", 3.0, 7), (2, "2 Elm", "z", "6", "http://b/2", 0.0, 99)], cols)
    q = spark.createDataFrame([(1, "google_rating", "3.0"), (1, "google_review_count", "7"), (2, "address", "2 Elm")], "id long, field string, old_value string")
    got = {r.id: tuple(r)[1:] for r in search.field_policy(stored, inc, q, {"postal_code": F.col("i_postal_code") == "z"}).collect()}
    assert got == {1: ("1 Oak", "x", None, "http://b/2", 4.0, 10), 2: (None, None, "5", "http://a/1", 4.0, 10), 3: (None,) * 6}


def test_hours_of_maps_and_pages(spark):
    m = [({"monday ": "4–9 PM", "Tuesday": "Closed", "wednesday": "11 AM–1 PM, 3–8 PM", "friday": "11 AM - 9 PM", "noday": "1-2", "sunday": None},), ({},), (None,)]
    got = [r[0] and [tuple(x) for x in r[0]] for r in spark.createDataFrame(m, "h map<string,string>").select(hours.listed_hours(F.col("h"))).collect()]
    assert got == [[("Monday", "4 PM", "9 PM"), ("Friday", "11 AM", "9 PM")], None, None]
    ld = '<script type="application/ld+json">{"openingHours": ["Mo-Tu 09:00-17:00", "bad"]}</script>'
    assert html.opening_hours(ld)["hours"] == [("Monday", "09:00", "17:00"), ("Tuesday", "09:00", "17:00")]
    assert html.opening_hours('<time datetime="Sa 22:00-02:00">x</time>')["hours"] == [("Saturday", "22:00", "02:00")]
    assert html.opening_hours("<p>We are open daily from 9:00 to 17:00.</p>")["raw"].startswith("We are open") and html.opening_hours("<p>open</p>") is None and html.opening_hours(None) is None


def test_accepted_of():
    import numpy as np

    us = np.array([0, 5, 10, 11, 12, 25], np.int64)
    assert accepted_of(us, None, 10) == [0, 3, 5] and accepted_of(us, 4, 10) == [5] and accepted_of(us[:0], None, 10) == []
