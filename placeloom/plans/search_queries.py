"""Sort modes, pages, the search merge, ingest and duplicate merging over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import integration, matching, quality, relational, search
from placeloom.plans.relational_queries import AS_OF
from placeloom.plans.scalar_queries import ADDRESS_SQL
from placeloom.plans.venue_queries import _COPIED, P10, km_sql
from placeloom.session import broadcast_if_small, materialize, table

C = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_DECAY = f"round(CASE WHEN updated_at IS NOT NULL THEN CAST(popularity_score AS DOUBLE) * greatest(0.5, 1.0 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400e6 / 90) END, 9)"
_BEST = f"{_DECAY} DESC NULLS LAST, id"
MODES = {
    "best_match": _BEST, "nearest_unknown": _BEST,
    "nearest": f"round({km_sql('43.0', '-114.1', 'CAST(latitude AS DOUBLE)', 'CAST(longitude AS DOUBLE)')}, 6) NULLS LAST, id",
    "rating": f"CASE WHEN google_review_count < 20 THEN CAST(google_rating AS DOUBLE) - 10 ELSE CAST(google_rating AS DOUBLE) END DESC NULLS LAST, {_BEST}",
    "reviews": f"coalesce(google_review_count, yelp_review_count) DESC NULLS LAST, {_BEST}",
}


def sorted_by(mode: str):
    def run(spark, d):
        r = table(spark, d, "restaurants").select("id", "popularity_score", "updated_at", "google_rating", "google_review_count", "yelp_review_count", C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
        far = geo.haversine_asin_km(F.lit(43.0), F.lit(-114.1), C("lat"), C("lng")) if mode == "nearest" else None
        return relational.ranked(r, "position", *search.sort_order(mode.split("_unknown")[0], AS_OF, far)).select("id", "position")

    return run


for _m, _sql in MODES.items():
    query(f"o03_{_m}", f"SELECT id, row_number() OVER (ORDER BY {_sql}) AS position FROM restaurants")(sorted_by(_m))


@query("o13_page_totals", f"SELECT id, row_number() OVER (ORDER BY {_BEST}) AS position, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 20.0) AS BIGINT) AS last_page, CAST(41 AS BIGINT) AS \"from\", least(count(*) OVER (), 60) AS \"to\" FROM restaurants QUALIFY position BETWEEN 41 AND 60")
def o13(spark, d):
    """Page 3 of a stored snapshot: page 1 ranks and stores, later pages read."""
    r = table(spark, d, "restaurants").select("id", "popularity_score", "updated_at")
    path = search.store_snapshot(r, "all", search.sort_order("best_match", AS_OF))
    return search.snapshot_page(spark, path, "all", 3, 20)


_SLUG = "regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SIDES = f"""
s AS (SELECT id AS stored_id, is_active, slug, {P10} AS p, lower(trim(name, ' ')) AS n, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng, name, phone, photo_url, CAST(google_rating AS DOUBLE) AS google_rating FROM restaurants),
v AS (SELECT DISTINCT id AS live_id, {_SLUG.format(c="concat_ws(' ', name, city)")} AS slug, {P10} AS p, lower(trim(name, ' ')) AS n, lat, lng, name, phone, photo_url, CAST(google_rating AS DOUBLE) AS google_rating FROM live_venues),
m0 AS (SELECT live_id, stored_id, is_active FROM v JOIN s ON v.slug = s.slug AND v.slug <> ''
  UNION SELECT live_id, stored_id, is_active FROM v JOIN s ON v.p = s.p
  UNION SELECT live_id, stored_id, is_active FROM v JOIN s ON v.n = s.n AND v.n <> '' AND v.lat <> 0 AND v.lng <> 0 AND s.lat <> 0 AND s.lng <> 0 AND {km_sql('v.lat', 'v.lng', 's.lat', 's.lng')} <= 0.2),
m AS (SELECT live_id, min(stored_id) AS stored_id FROM m0 WHERE is_active GROUP BY 1), shut AS (SELECT DISTINCT live_id FROM m0 WHERE NOT is_active)
"""


def sides(spark, d):
    keep = ["name", "phone", "photo_url"]
    r = table(spark, d, "restaurants").select(C("id").alias("stored_id"), "is_active", "slug", text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("name")).alias("n"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"), *keep, C("google_rating").cast("double").alias("google_rating"))
    v = table(spark, d, "live_venues").distinct().select(C("id").alias("live_id"), text.slug(F.concat_ws(" ", "name", "city")).alias("slug"), text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("name")).alias("n"), "lat", "lng", *keep, C("google_rating").cast("double").alias("google_rating"))
    return r, v


@query("j09_first_match", f"WITH {_SIDES} SELECT live_id, stored_id FROM m")
def j09(spark, d):
    r, v = sides(spark, d)
    return search.same_venue_matches(v, r.where("is_active"), ["slug", "p"], percent=100.0)


@query("j10_known_closed", f"WITH {_SIDES} SELECT live_id FROM shut WHERE live_id NOT IN (SELECT live_id FROM m)")
def j10(spark, d):
    r, v = sides(spark, d)
    keys = ["slug", "p"]
    return search.same_venue_matches(v, r.where("NOT is_active"), keys, percent=100.0).join(search.same_venue_matches(v, r.where("is_active"), keys, percent=100.0), "live_id", "left_anti").select("live_id")


_OVER = ", ".join(f"coalesce(f.{f}, a.{f}) AS {f}" for f in ("name", "phone", "photo_url", "google_rating"))
_LAST = lambda f, ok: f"arg_max(v.{f}, v.live_id) FILTER (WHERE {ok}) AS {f}"


@query("m04_search_merge", f"""
WITH {_SIDES},
f AS (SELECT stored_id, count(*) AS live_ids, {', '.join(_LAST(f, f"trim(v.{f}, ' ') <> ''") for f in ("name", "phone", "photo_url"))}, {_LAST('google_rating', 'v.google_rating > 0')} FROM m JOIN v USING (live_id) GROUP BY 1)
SELECT a.stored_id AS id, coalesce(f.live_ids, 0) AS live_ids, false AS persist, {_OVER} FROM s a LEFT JOIN f ON f.stored_id = a.stored_id WHERE a.is_active
UNION ALL SELECT live_id, 0, true, name, phone, photo_url, google_rating FROM v WHERE live_id NOT IN (SELECT live_id FROM m) AND live_id NOT IN (SELECT live_id FROM shut)""")
def m04(spark, d):
    r, v = sides(spark, d)
    return search.search_merge(r.where("is_active"), v, r.where("NOT is_active"), ["slug", "p"], ["name", "phone", "photo_url", "google_rating"], percent=100.0)


@query("j11_same_name_nearby", f"SELECT o.id, min(a.id) AS awarded_id FROM restaurants o JOIN restaurants a ON NOT o.has_award AND a.has_award AND lower(trim(o.name, ' ')) = lower(trim(a.name, ' ')) AND trim(o.name, ' ') <> '' AND o.latitude <> 0 AND o.longitude <> 0 AND a.latitude <> 0 AND a.longitude <> 0 AND {km_sql('CAST(o.latitude AS DOUBLE)', 'CAST(o.longitude AS DOUBLE)', 'CAST(a.latitude AS DOUBLE)', 'CAST(a.longitude AS DOUBLE)')} <= 1.5 GROUP BY 1")
def j11(spark, d):
    r = table(spark, d, "restaurants")
    side = lambda ok, i: r.where(ok).select(C("id").alias(i), F.lower(F.trim("name")).alias("n"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    return integration.nearby_alike(side("NOT has_award", "live_id"), side("has_award", "stored_id"), 1.5, 100.0).select(C("live_id").alias("id"), C("stored_id").alias("awarded_id"))


_V = "SELECT id, lower(trim(name, ' ')) AS n, " + P10 + " AS p, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng FROM restaurants WHERE latitude <> 0 AND longitude <> 0"


@query("m01_exact_pairs", f"WITH v AS ({_V}) SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND (a.p = b.p OR (a.n = b.n AND a.n <> '')) AND {km_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 0.2")
def m01(spark, d):
    v = table(spark, d, "restaurants").select(C("id").alias("ord"), "name", "phone", C("latitude").alias("lat"), C("longitude").alias("lng"))
    return matching.same_venue_edges(v, percent=100.0)


@query("j07_exact_nearest", f"""
WITH r AS ({_V}), q AS (SELECT id AS place_id, lower(trim(name, ' ')) AS n, list_filter(list_transform(coalesce(phones, []), lambda x: CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(x, '[^0-9]', '', 'g'), 10) END), lambda x: x IS NOT NULL) AS ps, lat, lng FROM places WHERE lat <> 0 AND lng <> 0),
j AS (SELECT r.id, q.place_id, coalesce(list_contains(q.ps, r.p), false) AS by_phone, abs(r.lat - q.lat) + abs(r.lng - q.lng) AS l1 FROM r JOIN q ON abs(r.lat - q.lat) < 0.01 AND {km_sql('r.lat', 'r.lng', 'q.lat', 'q.lng')} <= 0.2 AND (coalesce(list_contains(q.ps, r.p), false) OR (r.n = q.n AND r.n <> '')))
SELECT id, place_id, by_phone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY by_phone DESC, l1, place_id) AS k FROM j) WHERE k = 1""")
def j07(spark, d):
    from placeloom.plans.venue_queries import venue_pairs

    r, p = venue_pairs(spark, d)
    return matching.nearest_match(r, p, percent=100.0).select("id", "place_id", "by_phone")


_ZIPS = f"""
{ADDRESS_SQL.replace('restaurants', 'live_venues')},
lz AS (SELECT DISTINCT id, CASE WHEN regexp_matches(w[-1], '^\\d{{5}}(-\\d{{4}})?$') AND NOT (n = 2 AND len(w) = 1 AND NOT regexp_matches(p[1], '^\\d')) THEN left(w[-1], 5) END AS a_zip, CASE WHEN regexp_matches(trim(postal_code, ' '), '^\\d{{5}}(-\\d{{4}})?$') THEN left(trim(postal_code, ' '), 5) END AS p_zip FROM w)
"""
_TAKE = lambda f, far, more="": f"CASE WHEN trim(coalesce(i.{f}, ''), ' ') <> '' AND NOT coalesce({far}, false) AND (trim(coalesce(r.{f}, ''), ' ') = '' {more}) THEN i.{f} ELSE r.{f} END AS {f}"
_AWAY = lambda z: f"{z}.zip IS NOT NULL AND r.latitude <> 0 AND r.longitude <> 0 AND {km_sql(z + '.lat', z + '.lng', 'CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)')} > greatest(50, 3 * coalesce({z}.radius_km, 0))"


@query("m05_field_policy", f"""
WITH {_COPIED}, {_ZIPS},
fold AS (SELECT {P10} AS p, lower(trim(city, ' ')) AS ck, max(id) AS live_id FROM live_venues WHERE {P10} IS NOT NULL AND city IS NOT NULL GROUP BY 1, 2),
inc AS (SELECT DISTINCT ON (r.id) r.id, v.id AS live_id, v.address, v.postal_code, v.phone, v.photo_url, CAST(v.google_rating AS DOUBLE) AS gr, v.google_review_count AS gc FROM restaurants r JOIN fold ON fold.p = {P10.replace('phone', 'r.phone')} AND fold.ck = lower(trim(r.city, ' ')) JOIN live_venues v ON v.id = fold.live_id)
SELECT r.id, {_TAKE('address', _AWAY('za'))}, {_TAKE('postal_code', _AWAY('zp'))}, {_TAKE('phone', 'false')}, {_TAKE('photo_url', 'false', "OR (contains(lower(r.photo_url), 'gps-cs-s') AND NOT contains(lower(i.photo_url), 'gps-cs-s'))")},
  CASE WHEN i.gr > 0 AND NOT (bad.id IS NOT NULL AND i.gr = CAST(r.google_rating AS DOUBLE) AND greatest(0, coalesce(i.gc, 0)) = r.google_review_count) THEN i.gr ELSE CAST(r.google_rating AS DOUBLE) END AS google_rating,
  CASE WHEN i.gr > 0 AND NOT (bad.id IS NOT NULL AND i.gr = CAST(r.google_rating AS DOUBLE) AND greatest(0, coalesce(i.gc, 0)) = r.google_review_count) THEN greatest(0, coalesce(i.gc, 0)) ELSE r.google_review_count END AS google_review_count
FROM restaurants r LEFT JOIN inc i USING (id) LEFT JOIN bad USING (id) LEFT JOIN lz ON lz.id = i.live_id LEFT JOIN zip_centroids za ON za.zip = lz.a_zip LEFT JOIN zip_centroids zp ON zp.zip = lz.p_zip""")
def m05(spark, d):
    r = table(spark, d, "restaurants")
    key = lambda df: [text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("city")).alias("ck")]
    v = table(spark, d, "live_venues").distinct()
    fields = ["address", "postal_code", "phone", "photo_url", "google_rating", "google_review_count"]
    last = v.select(*key(v), "id", F.struct(*fields).alias("v")).where("p IS NOT NULL AND ck IS NOT NULL").groupBy("p", "ck").agg(F.max_by("v", "id").alias("v"))
    inc = r.select("id", *key(r)).join(last, ["p", "ck"]).select("id", "v.*")
    bad = quality.copied_ratings(r).select("id")
    log = r.join(bad, "id").select("id", F.explode(F.array(F.struct(F.lit("google_rating").alias("field"), C("google_rating").cast("double").cast("string").alias("old_value")), F.struct(F.lit("google_review_count").alias("field"), C("google_review_count").cast("string").alias("old_value")))).alias("x")).select("id", "x.*")
    # how far the incoming ZIPs lie from the stored pin
    z = broadcast_if_small(table(spark, d, "zip_centroids").select("zip", "lat", "lng", "radius_km"))
    pin = r.select("id", C("latitude").cast("double").alias("la"), C("longitude").cast("double").alias("lo"))
    zipped = inc.select("id", text.zip_of(C("address"), F.lit(None).cast("string")).alias("za"), text.zip_of(F.lit(None).cast("string"), C("postal_code")).alias("zp")).join(pin, "id")
    away = geo.known(C("la"), C("lo")) & (geo.haversine_asin_km(C("lat"), C("lng"), C("la"), C("lo")) > F.greatest(F.lit(50.0), 3 * F.coalesce("radius_km", F.lit(0.0))))
    one = lambda k, name: zipped.join(z, C(k) == C("zip")).where(away).select("id", F.lit(True).alias(name))
    known = r.join(one("za", "far_address"), "id", "left").join(one("zp", "far_postal"), "id", "left")
    return search.field_policy(known, inc, log, {"address": C("far_address"), "postal_code": C("far_postal")})


_PASSES = f"""
r AS (SELECT id, name, city, latitude, longitude, state, lower(trim(city, ' ')) AS ck, {P10} AS p FROM restaurants),
p1 AS (SELECT id AS dupe, min(id) OVER (PARTITION BY name, city, latitude, longitude) AS keep FROM r WHERE name IS NOT NULL AND city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
r1 AS (SELECT * FROM r WHERE id NOT IN (SELECT dupe FROM p1 WHERE dupe <> keep)),
p2 AS (SELECT id AS dupe, min(id) OVER (PARTITION BY p, ck) AS keep FROM r1 WHERE p IS NOT NULL AND ck IS NOT NULL),
r2 AS (SELECT *, lower(trim(name, ' ')) || '|' || ck AS k FROM r1 WHERE id NOT IN (SELECT dupe FROM p2 WHERE dupe <> keep) AND name IS NOT NULL AND ck IS NOT NULL AND latitude <> 0 AND longitude <> 0),
q AS (SELECT id, k, CAST(latitude AS DOUBLE) AS y, CAST(longitude AS DOUBLE) AS x, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM r2),
g AS (SELECT k, n, id, id AS keep, [{{'i': id, 'y': y, 'x': x}}] AS a FROM q WHERE n = 1
  UNION ALL SELECT q.k, q.n, q.id, coalesce(list_filter(g.a, lambda t: {km_sql('t.y', 't.x', 'q.y', 'q.x')} <= 0.15)[1].i, q.id), CASE WHEN len(list_filter(g.a, lambda t: {km_sql('t.y', 't.x', 'q.y', 'q.x')} <= 0.15)) = 0 THEN list_append(g.a, {{'i': q.id, 'y': q.y, 'x': q.x}}) ELSE g.a END FROM g JOIN q ON q.k = g.k AND q.n = g.n + 1),
c AS (SELECT dupe, keep, 1 AS pass FROM p1 WHERE dupe <> keep UNION ALL SELECT dupe, keep, 2 FROM p2 WHERE dupe <> keep UNION ALL SELECT id, keep, 3 FROM g WHERE id <> keep),
x AS (SELECT c.dupe, coalesce(d.keep, c.keep) AS keep, c.pass FROM c LEFT JOIN c d ON d.dupe = c.keep),
mapping AS (SELECT x.dupe, coalesce(d.keep, x.keep) AS keep, x.pass FROM x LEFT JOIN c d ON d.dupe = x.keep)
"""


def mapping(spark, d):
    """Duplicates in three passes: equal name, city and pin; phone and city; name and city near the smallest id."""
    r = table(spark, d, "restaurants").select("id", "name", "city", "latitude", "longitude", F.lower(F.trim("city")).alias("ck"), text.last_ten_digits(C("phone")).alias("p"))
    one = relational.exact_duplicates(r, ["name", "city", "latitude", "longitude"], "id")
    r1 = r.join(one.select(C("dupe").alias("id")), "id", "left_anti")
    two = relational.exact_duplicates(r1, ["p", "ck"], "id")
    r2 = r1.join(two.select(C("dupe").alias("id")), "id", "left_anti").where("name IS NOT NULL AND ck IS NOT NULL").select(C("id").alias("ord"), F.concat_ws("|", F.lower(F.trim("name")), "ck").alias("k"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    near = matching.grid_pairs(r2, r2.select(C("ord").alias("o2"), C("k").alias("k2"), "lat", "lng"), 0.15).where("ord < o2 AND k = k2")
    three = matching.greedy_anchors(r2.select("ord"), near.select(C("ord").alias("a"), C("o2").alias("b"))).where("ord <> anchor").select(C("ord").alias("dupe"), C("anchor").alias("keep"))
    return search.chained_merges(one, two, three)


@query("m11_chained_passes", f"WITH RECURSIVE {_PASSES} SELECT dupe, keep, pass FROM mapping")
def m11(spark, d):
    return mapping(spark, d)


@query("m10_merged_rows", f"""
WITH RECURSIVE {_PASSES}, j AS (SELECT t.*, coalesce(m.keep, t.id) AS k FROM restaurants t LEFT JOIN mapping m ON m.dupe = t.id)
SELECT k AS id, {', '.join(f"coalesce(arg_min({f}, (CASE WHEN id <> k THEN 1 ELSE 0 END, id)) FILTER (WHERE {f} IS NOT NULL AND {f} <> ''), max({f}) FILTER (WHERE id = k)) AS {f}" for f in ('website_url', 'photo_url', 'phone', 'description', 'price_range'))},
  {', '.join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in ('total_engagement', 'website_clicks_count', 'pageviews_count'))} FROM j GROUP BY k""")
def m10(spark, d):
    m, _ = materialize(mapping(spark, d), "mapping")
    return search.merged_pairs(table(spark, d, "restaurants"), m, ["website_url", "photo_url", "phone", "description", "price_range"], ["total_engagement", "website_clicks_count", "pageviews_count"])


@query("m10_merged_children", f"""
WITH RECURSIVE {_PASSES}
SELECT 'tag' AS child, coalesce(m.keep, x.restaurant_id) AS id, CAST(x.cuisine_id AS VARCHAR) AS what FROM cuisine_restaurant x LEFT JOIN mapping m ON m.dupe = x.restaurant_id
UNION SELECT 'document', coalesce(m.keep, x.restaurant_id), CAST(x.doc_id AS VARCHAR) FROM documents x LEFT JOIN mapping m ON m.dupe = x.restaurant_id WHERE x.restaurant_id IS NOT NULL
UNION SELECT 'match', coalesce(m.keep, x.id_a), CAST(x.match_id AS VARCHAR) FROM venue_matches x LEFT JOIN mapping m ON m.dupe = x.id_a WHERE x.id_a IS NOT NULL""")
def m10c(spark, d):
    """Tags, documents and matches of a duplicate go to the row that is kept; what is then equal stands once."""
    m, _ = materialize(mapping(spark, d), "mapping")
    part = lambda t, ref, what, kind: search.repointed(table(spark, d, t).where(f"{ref} IS NOT NULL").select(F.lit(kind).alias("child"), C(ref).cast("long").alias("id"), C(what).cast("string").alias("what")), m, "id")
    return part("cuisine_restaurant", "restaurant_id", "cuisine_id", "tag").unionByName(part("documents", "restaurant_id", "doc_id", "document")).unionByName(part("venue_matches", "id_a", "match_id", "match"))


@query("m14_photo_verdicts", f"""
WITH r AS (SELECT id, regexp_extract(photo_url, '([^/]+)$', 1) AS f, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng, google_rating, google_review_count FROM restaurants),
g AS (SELECT regexp_extract(photo_url, '([^/]+)$', 1) AS f, lat, lng FROM live_venues WHERE lat <> 0 AND lng <> 0 AND regexp_extract(photo_url, '([^/]+)$', 1) <> ''),
b AS (SELECT r.id, min({km_sql('r.lat', 'r.lng', 'g.lat', 'g.lng')}) AS km FROM r JOIN g USING (f) GROUP BY 1)
SELECT r.id, CASE WHEN coalesce(r.f, '') = '' OR NOT coalesce(r.lat <> 0 AND r.lng <> 0, false) THEN 'uncheckable' WHEN b.km <= 1.0 THEN 'verified' ELSE 'unverified' END AS verdict FROM r LEFT JOIN b USING (id)""")
def m14(spark, d):
    """A photo is verified where a geotag of the same file lies within a kilometre of the venue."""
    f = F.regexp_extract("photo_url", "([^/]+)$", 1)
    r = table(spark, d, "restaurants").select("id", f.alias("f"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    g = table(spark, d, "live_venues").where(geo.known(C("lat"), C("lng"))).select(f.alias("f"), C("lat").alias("g_lat"), C("lng").alias("g_lng")).where("f <> ''")
    b = r.where("f <> ''").join(g, "f").groupBy("id").agg(F.min(geo.haversine_asin_km(C("lat"), C("lng"), C("g_lat"), C("g_lng"))).alias("km"))
    bare = F.coalesce(C("f") == "", F.lit(True)) | ~geo.known(C("lat"), C("lng"))
    return r.join(b, "id", "left").select("id", F.when(bare, "uncheckable").when(C("km") <= 1.0, "verified").otherwise("unverified").alias("verdict"))


@query("t02_accepted_batch", """
WITH RECURSIVE e AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600000001 MICROSECONDS FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM e),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT n.user_id, n.event_type, n.next_ts FROM k JOIN n USING (user_id, event_type, ts) WHERE n.next_ts IS NOT NULL)
SELECT e.event_id, e.user_id, e.event_type FROM k JOIN e USING (user_id, event_type, ts)""")
def t02(spark, d):
    """Accepted events of the stream, with an hour as the span so that it bites."""
    from placeloom.streaming import engagement

    return engagement.accepted_events(engagement.stream(spark, f"{d}/events.parquet"), 3600.0).select("event_id", "user_id", "event_type")


# smaller pieces of the inventory


@query("k02_upsert_fresh", f"WITH b AS (SELECT group_id, id, fetched_at FROM live_venues WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) SELECT group_id, id, fetched_at FROM (SELECT DISTINCT *, rank() OVER (PARTITION BY group_id ORDER BY fetched_at DESC, id DESC) AS k FROM b) WHERE k = 1")
def k02(spark, d):
    """One entry for each key, the newest; entries older than the cache's lifetime count as absent."""
    fresh = table(spark, d, "live_venues").where(C("fetched_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 90 DAYS"))
    return fresh.groupBy("group_id").agg(F.max(F.struct("fetched_at", "id")).alias("b")).select("group_id", "b.id", "b.fetched_at")


@query("o16_version_order", "WITH v AS (SELECT id % 7 AS g, '1.' || CAST(id % 12 AS VARCHAR) || '.' || CAST(id % 5 AS VARCHAR) AS version FROM restaurants) SELECT g, arg_max(version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))) AS version FROM v GROUP BY 1")
def o16(spark, d):
    """Versions such as 1.10 and 1.9, of which the first is the greater."""
    v = table(spark, d, "restaurants").select((C("id") % 7).alias("g"), F.concat(F.lit("1."), (C("id") % 12).cast("string"), F.lit("."), (C("id") % 5).cast("string")).alias("version"))
    return v.groupBy("g").agg(F.max_by("version", F.transform(F.split("version", "[.]"), lambda x: x.cast("int"))).alias("version"))


@query("x25_json_attempts", "SELECT id, strftime(greatest(created_at, updated_at), '%Y-%m-%d %H:%M:%S') AS last_attempt FROM restaurants")
def x25(spark, d):
    """The later of two times that stand in a JSON document, either of which may be missing."""
    j = table(spark, d, "restaurants").select("id", F.to_json(F.struct(F.struct(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at")).alias("photo"), F.struct(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("at")).alias("site"))).alias("j"))
    at = lambda k: F.get_json_object("j", f"$.{k}.at").try_cast("timestamp")
    return j.select("id", F.date_format(F.greatest(at("photo"), at("site")), "yyyy-MM-dd HH:mm:ss").alias("last_attempt"))


@query("x27_fine_boxes", "SELECT zip, round(radius_km / 111.32, 6) AS d_lat, round(radius_km / (111.32 * cos(radians(lat))), 6) AS d_lng FROM zip_centroids")
def x27(spark, d):
    return table(spark, d, "zip_centroids").select("zip", F.round(C("radius_km") / 111.32, 6).alias("d_lat"), F.round(C("radius_km") / (111.32 * F.cos(F.radians("lat"))), 6).alias("d_lng"))


@query("x21_street_number", r"SELECT doc_id, coalesce(regexp_matches(text, '\b\d{1,5}[A-Za-z]?\s+(\w+\s+){0,3}?(street|st|avenue|ave|road|rd|lane|ln|drive|dr)\b', 'i'), false) AS has_address FROM documents")
def x21(spark, d):
    p = r"(?i)\b[0-9]{1,5}[A-Za-z]?\s+([0-9A-Za-z_]+\s+){0,3}?(street|st|avenue|ave|road|rd|lane|ln|drive|dr)\b"
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.rlike("text", F.lit(p)), F.lit(False)).alias("has_address"))


@query("r08_flags", "SELECT id, CASE WHEN has_award THEN 1.0 ELSE 0.0 END AS award, round(greatest(0.0, least(1.0, CAST(overture_confidence AS DOUBLE))), 6) AS confidence FROM restaurants WHERE overture_confidence IS NOT NULL")
def r08(spark, d):
    from placeloom.operators.scoring import clamp

    return table(spark, d, "restaurants").where("overture_confidence IS NOT NULL").select("id", F.when(C("has_award"), 1.0).otherwise(0.0).alias("award"), F.round(clamp(C("overture_confidence").cast("double")), 6).alias("confidence"))


@query("r12_neutral_proximity", f"SELECT id, CASE WHEN latitude <> 0 AND longitude <> 0 THEN round(1 / (1 + {km_sql('43.0', '-114.1', 'CAST(latitude AS DOUBLE)', 'CAST(longitude AS DOUBLE)')} / 2.0), 6) ELSE 0.5 END AS proximity FROM restaurants")
def r12(spark, d):
    """Rows without known coordinates are neither near nor far."""
    far = geo.haversine_asin_km(F.lit(43.0), F.lit(-114.1), C("latitude").cast("double"), C("longitude").cast("double"))
    return table(spark, d, "restaurants").select("id", F.when(geo.known(C("latitude"), C("longitude")), F.round(1 / (1 + far / 2.0), 6)).otherwise(0.5).alias("proximity"))


@query("u07_distinct_venues", "SELECT n, y, x, min(ord) AS ord FROM (SELECT lower(trim(name, ' ')) AS n, CAST(floor(lat * 10000) AS BIGINT) AS y, CAST(floor(lng * 10000) AS BIGINT) AS x, ord FROM live_venues WHERE name IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL) GROUP BY 1, 2, 3")
def u07(spark, d):
    """One entry for each name and rounded position, the first in source order."""
    v = table(spark, d, "live_venues").where("name IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    return v.groupBy(F.lower(F.trim("name")).alias("n"), F.floor(C("lat") * 10000).alias("y"), F.floor(C("lng") * 10000).alias("x")).agg(F.min("ord").alias("ord"))


@query("y02_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.deep') AS none FROM events")
def y02(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing.deep").alias("none"))


@query("y04_distinct_of_structs", "SELECT id, array_to_string(list_sort(list_distinct(coalesce(datasets, []))), ',') AS sources FROM places")
def y04(spark, d):
    from placeloom.sources.places import nested

    n = nested(table(spark, d, "places"))
    return n.select("id", F.array_join(F.array_sort(F.array_distinct(F.transform("sources", lambda x: x["dataset"]))), ",").alias("sources"))


@query("y03_tolerant_decode", "SELECT id, len(coalesce(datasets, [])) AS n FROM places")
def y03(spark, d):
    """A list, one object instead of a list, or broken text: the first two count, the last is empty."""
    k = F.size(F.coalesce("datasets", F.array().cast("array<string>")))
    text_ = F.when(k == 0, "{broken").when(k == 1, F.to_json(F.struct(C("datasets")[0].alias("x")))).otherwise(F.to_json(F.transform("datasets", lambda x: F.struct(x.alias("x")))))
    p = table(spark, d, "places").select("id", text_.alias("t"))
    many, one = F.from_json("t", "array<struct<x:string>>"), F.get_json_object("t", "$.x")
    return p.select("id", F.when(F.left("t", F.lit(1)) == "[", F.size(many)).when(one.isNotNull(), 1).otherwise(0).cast("long").alias("n"))


@query("j13_cluster_members", f"WITH c AS (SELECT CAST(floor(lat / 0.2) AS BIGINT) AS cy, CAST(floor(lng / 0.2) AS BIGINT) AS cx, avg(lat) AS y, avg(lng) AS x FROM places WHERE lat <> 0 AND lng <> 0 GROUP BY 1, 2) SELECT p.id, round({km_sql('c.y', 'c.x', 'p.lat', 'p.lng')}, 4) AS km FROM places p JOIN c ON c.cy = floor(p.lat / 0.2) AND c.cx = floor(p.lng / 0.2) WHERE p.lat <> 0 AND p.lng <> 0")
def j13(spark, d):
    y, x = geo.cell(C("lat"), C("lng"), 0.2)
    p = table(spark, d, "places").where("lat <> 0 AND lng <> 0").select("id", "lat", "lng", y.alias("cy"), x.alias("cx"))
    c = p.groupBy("cy", "cx").agg(F.avg("lat").alias("y"), F.avg("lng").alias("x"))
    return p.join(c, ["cy", "cx"]).select("id", F.round(geo.haversine_asin_km(C("y"), C("x"), C("lat"), C("lng")), 4).alias("km"))


@query("j14_nearest_of_city", f"""
WITH g AS (SELECT lower(trim(city, ' ')) AS ck, upper(trim(region, ' ')) AS st, round(lat, 1) AS y, round(lng, 1) AS x FROM places WHERE lat <> 0 AND lng <> 0 GROUP BY ALL),
j AS (SELECT r.id, min({km_sql('g.y', 'g.x', 'CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)')}) AS km FROM restaurants r JOIN g ON g.ck = lower(trim(r.city, ' ')) AND g.st = upper(trim(r.state, ' ')) WHERE r.latitude <> 0 AND r.longitude <> 0 GROUP BY 1)
SELECT id, km > 50 AS far FROM j""")
def j14(spark, d):
    """The nearest known point of a row's city and state; far where even that is beyond 50 km. Points are cells of a tenth of a degree."""
    g = table(spark, d, "places").where("lat <> 0 AND lng <> 0").select(F.lower(F.trim("city")).alias("ck"), F.upper(F.trim("region")).alias("st"), F.round("lat", 1).alias("y"), F.round("lng", 1).alias("x")).distinct()
    r = table(spark, d, "restaurants").where("latitude <> 0 AND longitude <> 0").select("id", F.lower(F.trim("city")).alias("ck"), F.upper(F.trim("state")).alias("st"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    return r.join(g, ["ck", "st"]).groupBy("id").agg((F.min(geo.haversine_asin_km(C("y"), C("x"), C("lat"), C("lng"))) > 50).alias("far"))


@query("d08_corrected_codes", f"""
WITH r AS (SELECT id, postal_code, substr(postal_code, 1, 5) AS z, regexp_extract(address, '(\\d{{5}})(-\\d{{4}})?$', 1) AS a, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng FROM restaurants WHERE latitude <> 0 AND longitude <> 0)
SELECT r.id, CASE WHEN {km_sql('z.lat', 'z.lng', 'r.lat', 'r.lng')} <= 50 THEN r.postal_code WHEN w.zip IS NOT NULL AND {km_sql('w.lat', 'w.lng', 'r.lat', 'r.lng')} <= 50 THEN r.a END AS postal_code FROM r JOIN zip_centroids z ON z.zip = r.z LEFT JOIN zip_centroids w ON w.zip = r.a""")
def d08(spark, d):
    """The code that stays: the row's own near its pin, else the address's near the pin, else none."""
    z = table(spark, d, "zip_centroids")
    side = lambda k, p: broadcast_if_small(z.select(C("zip").alias(k), C("lat").alias(f"{p}_lat"), C("lng").alias(f"{p}_lng")))
    r = table(spark, d, "restaurants").where("latitude <> 0 AND longitude <> 0").select("id", "postal_code", F.substring("postal_code", 1, 5).alias("z"), F.regexp_extract("address", r"(\d{5})(-\d{4})?$", 1).alias("a"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    near = lambda p: geo.haversine_asin_km(C(f"{p}_lat"), C(f"{p}_lng"), C("lat"), C("lng")) <= 50
    return r.join(side("z", "o"), "z").join(side("a", "w"), "a", "left").select("id", F.when(near("o"), C("postal_code")).when(C("w_lat").isNotNull() & near("w"), C("a")).alias("postal_code"))


@query("d10_guessed_fields", "SELECT id, f AS field, 'guessed' AS reason, field_sources[f] AS detail FROM (SELECT id, field_sources, unnest(map_keys(field_sources)) AS f FROM restaurants) WHERE split_part(field_sources[f], ':', 1) IN ('photon', 'serpapi')")
def d10(spark, d):
    """Fields whose note says that they come from a source that guesses."""
    f = table(spark, d, "restaurants").select("id", F.explode("field_sources").alias("field", "detail"))
    return f.where(F.split_part("detail", F.lit(":"), F.lit(1)).isin("photon", "serpapi")).select("id", "field", F.lit("guessed").alias("reason"), "detail")


@query("m17_united_notes", f"WITH RECURSIVE {_PASSES} SELECT coalesce(m.keep, r.id) AS id, string_agg(DISTINCT f, ',' ORDER BY f) AS fields FROM (SELECT id, unnest(map_keys(field_sources)) AS f FROM restaurants) r LEFT JOIN mapping m ON m.dupe = r.id GROUP BY 1")
def m17(spark, d):
    """The fields that any of a venue's merged rows notes a source for, each once."""
    f = table(spark, d, "restaurants").select("id", F.explode(F.map_keys("field_sources")).alias("f"))
    m = mapping(spark, d).select(C("dupe").alias("id"), "keep")
    return f.join(m, "id", "left").groupBy(F.coalesce("keep", "id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("fields"))


@query("m12_directory_applied", f"""
WITH r AS ({_V}), q AS (SELECT id AS place_id, lower(trim(name, ' ')) AS n, list_filter(list_transform(coalesce(phones, []), lambda x: CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(x, '[^0-9]', '', 'g'), 10) END), lambda x: x IS NOT NULL) AS ps, lat, lng FROM places WHERE lat <> 0 AND lng <> 0),
j AS (SELECT r.id, q.place_id, coalesce(list_contains(q.ps, r.p), false) AS by_phone, abs(r.lat - q.lat) + abs(r.lng - q.lng) AS l1 FROM r JOIN q ON abs(r.lat - q.lat) < 0.01 AND {km_sql('r.lat', 'r.lng', 'q.lat', 'q.lng')} <= 0.2 AND (coalesce(list_contains(q.ps, r.p), false) OR (r.n = q.n AND r.n <> ''))),
b AS (SELECT id, place_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY by_phone DESC, l1, place_id) AS k FROM j) WHERE k = 1),
t AS (SELECT r.id, r.address, r.website_url, p.street, p.websites[1] AS site, p.operating_status, p.datasets, r.field_sources FROM restaurants r JOIN b USING (id) JOIN places p ON p.id = b.place_id),
u AS (SELECT *, trim(coalesce(address, ''), ' ') = '' AND trim(coalesce(street, ''), ' ') <> '' AS fa, trim(coalesce(website_url, ''), ' ') = '' AND trim(coalesce(site, ''), ' ') <> '' AS fw FROM t)
SELECT id, CASE WHEN fa THEN street ELSE address END AS address, CASE WHEN fw THEN site ELSE website_url END AS website_url, coalesce(operating_status = 'closed', false) AS closed, len(list_distinct(coalesce(datasets, []))) AS sources,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(map_keys(field_sources), []), CASE WHEN fa THEN ['address'] ELSE [] END, CASE WHEN fw THEN ['website_url'] ELSE [] END))), ',') AS noted FROM u""")
def m12(spark, d):
    """A place applied to the row it matches: blanks filled and noted, closure, and how many datasets corroborate it."""
    from placeloom.plans.venue_queries import venue_pairs

    r, p = venue_pairs(spark, d)
    b = matching.nearest_match(r, p, percent=100.0).select("id", "place_id")
    pl = table(spark, d, "places").select(C("id").alias("place_id"), C("street").alias("address"), F.get("websites", 0).alias("website_url"), "operating_status", "datasets")
    # read three times below
    inc, _ = materialize(b.join(pl, "place_id"), "directory")
    kept = table(spark, d, "restaurants").select("id", "address", "website_url", "field_sources").join(inc.select("id"), "id", "left_semi")
    f = integration.filled_from(kept, inc.select("id", "address", "website_url"), "id", ["address", "website_url"], F.lit("directory"))
    return f.join(inc.select("id", "operating_status", "datasets"), "id").select("id", "address", "website_url", F.coalesce(C("operating_status") == "closed", F.lit(False)).alias("closed"), F.size(F.array_distinct(F.coalesce("datasets", F.array().cast("array<string>")))).cast("long").alias("sources"), F.array_join(F.array_sort(F.map_keys("field_sources")), ",").alias("noted"))


@query("m15_ingested", rf"""
WITH v0 AS (SELECT DISTINCT id, name, phone, city, google_rating, google_review_count FROM live_venues),
v AS (SELECT id, name, CAST(google_rating AS DOUBLE) AS rating, google_review_count AS n, CASE WHEN {P10} IS NOT NULL AND city IS NOT NULL THEN {P10} || '|' || lower(trim(city, ' ')) END AS k FROM v0 WHERE trim(coalesce(name, ''), ' ') <> '' AND NOT regexp_matches(trim(name, ' '), '^\d+$') AND lower(trim(name, ' ')) NOT IN ('diner', 'restaurant', 'cafe', 'food', 'bar', 'grill') AND NOT regexp_matches(lower(name), '\b(salon|barber|church|gym|clinic|bank|parking)\b')),
a AS (SELECT * FROM v WHERE k IS NULL OR id = (SELECT max(w.id) FROM v w WHERE w.k = v.k)),
s AS (SELECT {P10} || '|' || lower(trim(city, ' ')) AS k, min(id) AS stored FROM restaurants WHERE {P10} IS NOT NULL AND city IS NOT NULL GROUP BY 1),
m AS (SELECT coalesce(avg(rating) FILTER (WHERE rating > 0 AND n >= 50), 4.0) AS c FROM a)
SELECT a.id, s.stored, CASE WHEN s.stored IS NULL THEN 'insert' ELSE 'update' END AS action, round(CASE WHEN rating > 0 THEN greatest(0.0, least(1.0, (coalesce(n, 0) / (coalesce(n, 0) + 50.0) * rating + 50 / (coalesce(n, 0) + 50.0) * c) / 5)) END, 6) AS quality FROM a CROSS JOIN m LEFT JOIN s USING (k)""")
def m15(spark, d):
    """Live records taken in: real names of eating places, one record for each phone and city (the first by id), the row each
    goes to, and its quality against the mean of just this batch."""
    n = F.trim("name")
    bad = (n == "") | n.rlike(r"^\d+$") | F.lower(n).isin("diner", "restaurant", "cafe", "food", "bar", "grill") | F.lower("name").rlike(r"\b(salon|barber|church|gym|clinic|bank|parking)\b")
    key = lambda: F.when(text.last_ten_digits(C("phone")).isNotNull() & C("city").isNotNull(), F.concat_ws("|", text.last_ten_digits(C("phone")), F.lower(F.trim("city"))))
    v = table(spark, d, "live_venues").select("id", "name", C("google_rating").cast("double").alias("rating"), C("google_review_count").alias("n"), key().alias("k")).where(F.coalesce(~bad, F.lit(False))).distinct()
    first = v.groupBy(F.coalesce("k", F.concat(F.lit("#"), C("id").cast("string"))).alias("kk")).agg(F.max_by(F.struct("id", "rating", "n", "k"), "id").alias("b")).select("b.*")
    stored = table(spark, d, "restaurants").select("id", key().alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("stored"))
    mean = F.broadcast(first.agg(F.coalesce(F.avg(F.when((C("rating") > 0) & (C("n") >= 50), C("rating"))), F.lit(4.0)).alias("c")))
    count = F.coalesce("n", F.lit(0)).cast("double")
    quality_ = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (count / (count + 50) * C("rating") + 50 / (count + 50) * C("c")) / 5))
    return first.crossJoin(mean).join(stored, "k", "left").select("id", "stored", F.when(C("stored").isNull(), "insert").otherwise("update").alias("action"), F.round(F.when(C("rating") > 0, quality_), 6).alias("quality"))
