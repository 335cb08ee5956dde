import random

from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.functions.geo import haversine_km
from placeloom.operators import matching as m


def plain(a: bytes, b: bytes) -> int:
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return k + plain(a[:i], b[:j]) + plain(a[i + k :], b[j + k :]) if k else 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_common_bytes(a, b):
    assert m.common_bytes(a.encode(), b.encode()) == plain(a.encode(), b.encode())


def test_percent():
    assert m.likeness_percent("World", "Word") == 200 * 4 / 9 and m.likeness_percent(None, "x") is None and m.likeness_percent("", "") == 0.0


def test_grid_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    a = [(i, rng.choice([40.0, 65.0, -33.0]) + rng.gauss(0, 0.004), -100 + rng.gauss(0, 0.004)) for i in range(150)] + [(900, 0.0, -100.0), (901, None, None)]
    b = [(i, la + rng.gauss(0, 0.001), ln + rng.gauss(0, 0.001)) for i, la, ln in a[:150]]
    x, y = spark.createDataFrame(a, "id long, lat double, lng double"), spark.createDataFrame(b, "other long, lat double, lng double")
    got = {(r.id, r.other) for r in m.grid_pairs(x, y, 0.3).collect()}
    j = x.where("lat <> 0 AND lng <> 0").crossJoin(y.toDF("other", "la", "ln"))
    assert got == {(r.id, r.other) for r in j.where(haversine_km(j.lat, j.lng, j.la, j.ln) <= 0.3).collect()}


def test_greedy_anchors(spark):
    rng = random.Random(9)
    n = 120
    edges = {(a, b) for _ in range(150) for a, b in [sorted(rng.sample(range(n), 2))]} | {(i, i + 1) for i in range(30)}
    anchors, fold = [], {}
    for i in range(n):
        first = next((a for a in anchors if (a, i) in edges), None)
        fold[i] = i if first is None else first
        if first is None:
            anchors.append(i)
    rows = spark.range(n).toDF("ord")
    got = {r.ord: r.anchor for r in m.greedy_anchors(rows, spark.createDataFrame(sorted(edges), "a long, b long"), 200).collect()}
    assert got == fold
    assert m.greedy_anchors(rows.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_merged(spark):
    rows = [(1, 1, "", None, None, 0, ["x"]), (1, 2, "B", "0", 4.5, 9, ["y", "x"]), (1, 3, "C", "z", 5.0, 1, None), (2, 1, None, None, 0.0, 7, None)]
    df = spark.createDataFrame(rows, "g long, ord long, name string, price string, rating double, n long, tags array<string>")
    got = {r.g: r for r in m.merged(df, "g", "ord", ["name", "price"], [("rating", "n")], ["tags"]).collect()}
    assert got[1].asDict() == {"g": 1, "name": "B", "price": "0", "rating": 4.5, "n": 9, "tags": ["x", "y"]}
    assert got[2].name is None and got[2].n == 7 and got[2].tags == []


def test_equal_names_meet_within_their_key_only(spark):
    rng = random.Random(3)
    at = lambda: (40.0 + rng.gauss(0, 0.002), -100.0 + rng.gauss(0, 0.002))
    names, phones = ["Blue Oven", " blue oven ", "Crane", "", None, "Otter"], ["5550001111", "5550002222", "5550003333", None]
    v = [(i, rng.choice(names), rng.choice(phones), *at()) for i in range(80)] + [(900, "Crane", None, 0.0, -100.0), (901, "Crane", "5550001111", None, None)]
    p = [(f"p{i}", rng.choice(names), rng.choice([[], None, [phones[0]], [phones[1], phones[2]]]), *at()) for i in range(80)]
    p += [(f"{x[0]}-copy", *x[1:]) for x in p[:40]] + [(f"a{x[0]}", *x[1:]) for x in p[40:60]]
    venues, places = spark.createDataFrame(v, "id long, name string, phone string, lat double, lng double"), spark.createDataFrame(p, "place_id string, place_name string, place_phones array<string>, lat double, lng double")
    j = venues.where("lat <> 0").crossJoin(places.withColumnsRenamed({"lat": "la", "lng": "ln"}))
    near = j.where(haversine_km(j.lat, j.lng, j.la, j.ln) <= 0.2).collect()
    want: dict = {}
    for r in near:
        phone = r.phone is not None and r.phone in (r.place_phones or [])
        if phone or ((r.name or "").strip() and r.name.strip().lower() == (r.place_name or "").strip().lower()):
            want[r.id] = min(want.get(r.id, (2,)), (not phone, abs(r.lat - r.la) + abs(r.lng - r.ln), r.place_id))
    out = m.nearest_match(venues, places, percent=100.0)
    assert {r.id: (not r.by_phone, r.place_id) for r in out.collect()} == {i: (w[0], w[2]) for i, w in want.items()} and len(want) > 40
    # rows that share a cell alone are not compared: the join asks for the key too
    assert "_key" in next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x)
