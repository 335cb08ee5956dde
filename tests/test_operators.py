from pyspark.sql import functions as F

from placeloom.operators import quality, relational, relevance, scoring
from placeloom.sources import adapters, places


def test_ranked_spans_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("s"))
    got = {r.id: r.p for r in relational.ranked(df, "p", F.col("s").desc(), F.col("id"), spread=5).collect()}
    want = {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert got == want
    assert relational.ranked(df.limit(0), "p", F.col("id")).count() == 0


def test_pushdown_of_the_box(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 1.0D AS latitude", "-id * 1.0D AS longitude", "'x' AS other").write.parquet(str(tmp_path / "t"))
    plan = relational.nearby(spark.read.parquet(str(tmp_path / "t")), 10.0, -10.0, 50.0).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "other" not in plan


def test_upsert_patch_page(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", None)], "id long, v string, at long")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (4, "D", None)], "id long, v string, at long")
    assert {r.id: r.v for r in relational.upsert(old, new, ["id"], "at").collect()} == {1: "A", 2: "b", 3: "c", 4: "D"}
    u = spark.createDataFrame([(1, "Z"), (2, None)], "id long, v string")
    assert {r.id: r.v for r in relational.patched(old, u, "id", ["v"]).collect()} == {1: "Z", 2: "b", 3: "c"}
    p = relational.page(old, 2, 2, F.col("id")).collect()
    assert [(r.id, r.position, r.total, r.last_page) for r in p] == [(3, 3, 3, 2)]


R = "id long, name string, google_rating double, google_review_count int, latitude double, longitude double, website_clicks_count int, has_award boolean, overture_confidence double, website_url string"


def test_scores(spark):
    rows = [(1, "a", 5.0, 3, 1.0, 1.0, 0, False, None, None), (2, "b", 4.8, 5000, 1.0, 1.0, 10, False, None, None), (3, "c", None, 0, None, None, 0, None, 0.9, "http://x"), (4, None, None, None, 0.0, 0.0, None, True, None, "")]
    df = spark.createDataFrame(rows, R)
    stats = scoring.collection_stats(df)
    assert stats.first().mean_rating == 4.8 and stats.first().den_pageviews_count == 5000.0
    s = {r.id: r for r in scoring.scored(df, stats, breakdown=True).collect()}
    assert all(0 <= r.score <= 1 for r in s.values()) and s[2].score > s[1].score
    assert {x.signal for x in s[3].breakdown} & {"quality", "evidence"} == {"evidence"} and "has_award" in {x.signal for x in s[4].breakdown}
    c = [x.contribution for x in s[2].breakdown]
    assert c == sorted(c, reverse=True)
    empty = scoring.collection_stats(df.limit(0)).first()
    assert empty.mean_rating == 4.0
    none = scoring.scored(df, stats, scoring.ScoringConfig(weights={}))
    assert {r.score for r in none.collect()} == {0.0}


def test_first_click_does_not_lower(spark):
    a = spark.createDataFrame([(1, "a", 4.0, 100, 1.0, 1.0, 0, False, None, None), (2, "a", 4.0, 100, 1.0, 1.0, 1, False, None, None)], R)
    s = {r.id: r.score for r in scoring.scored(a, scoring.collection_stats(a)).collect()}
    assert s[2] >= s[1]


def test_scope():
    lex, cats = {"thai": ["thai"], "thai fusion": ["thai fusion", "fusion"], "pizza": ["pizza"]}, {"asian": ["thai", "thai fusion"]}
    assert relevance.resolve("Asian ", lex, cats).slugs == ("thai", "thai fusion") and not relevance.resolve("x", lex, cats).valid
    assert "pizza" in relevance.resolve("thai", lex, cats).rival and relevance.resolve(None, lex, cats).on == ""


def test_quarantine_and_restore(spark):
    r = spark.createDataFrame([(1, "p1", 3.5), (2, "p2", None)], "id long, phone string, rating double")
    f = spark.createDataFrame([(1, "phone", "copied", "x"), (1, "phone", "again", "x"), (2, "rating", "r", "x")], "id long, field string, reason string, detail string")
    view, log = quality.quarantine(r, f, ["phone", "rating"])
    assert {(x.id, x.phone, x.rating) for x in view.collect()} == {(1, None, 3.5), (2, "p2", None)} and log.count() == 2
    assert {(x.id, x.phone, x.rating) for x in quality.restored(view, log, ["phone", "rating"]).collect()} == {(1, "p1", 3.5), (2, "p2", None)}


DOCS = {
    "bizdata": ('{"results": [{"name": "A", "latitude": "40.5", "longitude": "x", "categories": ["cafe"]}, {"name": "B"}]}', ["A", "B"], 40.5),
    "overpass": ('{"elements": [{"lat": 1.5, "lon": 2, "tags": {"name": "A", "cuisine": "thai; sushi", "addr:street": "Oak St", "addr:housenumber": "5"}}, {"center": {"lat": 3, "lon": 4}, "tags": {"name": "B"}}]}', ["A", "B"], 1.5),
    "serpapi": ('{"local_results": [{"title": "A", "gps_coordinates": {"latitude": 7.5, "longitude": 8}, "type": "Bar", "types": ["Bar", "Pub"]}]}', ["A"], 7.5),
    "socrata": ('[{"dba": "", "business_name": "A", "location": {"latitude": "9.5", "longitude": "1"}}]', ["A"], 9.5),
    "photon": ('{"features": [{"geometry": {"coordinates": [-100.5, 44.5]}, "properties": {"name": "A"}}]}', ["A"], 44.5),
    "wikidata": ('{"results": {"bindings": [{"label": {"value": "A"}, "coord": {"value": "Point(-100.5 45.5)"}}]}}', ["A"], 45.5),
}


def test_adapters(spark):
    parts = []
    for name, (doc, names, lat) in DOCS.items():
        df = spark.createDataFrame([(doc,), ("not json",), (None,)], "payload string")
        rows = adapters.ADAPTERS[name](df, "payload").orderBy("ord").collect()
        assert [r.name for r in rows] == names and rows[0].lat == lat and rows[0].source == name, name
        parts.append(adapters.ADAPTERS[name](df, "payload"))
    u = adapters.union_in_order(parts)
    assert u.count() == 8 and u.select("ord").distinct().count() == 8
    assert [r.source for r in u.orderBy("ord").collect()][0] == "bizdata"


def test_extract_round_trip(spark, tmp_path):
    flat = spark.read.parquet("/root/testdata/sf0.001/places.parquet")
    back = places.flattened(places.nested(flat))
    assert back.select("id", "street", "lat").exceptAll(flat.select("id", "street", "lat")).count() == 0
    places.write_extract(back, str(tmp_path / "x"))
    assert places.read_box(spark, str(tmp_path / "x"), -90, 90, -180, 180).count() == flat.where("lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180").count()
