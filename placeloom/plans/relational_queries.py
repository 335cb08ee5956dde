"""Filters, joins, aggregates, rankings and write plans over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import relational as rel
from placeloom.operators.scoring import decayed
from placeloom.session import broadcast_if_small, table

C = F.col
AS_OF = "2026-06-30 00:00:00"
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def has(c: str) -> Column:
    return C(c).isNotNull() & (C(c) != "")


# filters


@query("s01_active", "SELECT id, name, city FROM restaurants WHERE is_active")
def s01(spark, d):
    return table(spark, d, "restaurants").where("is_active").select("id", "name", "city")


@query("s03_box_scan", "SELECT id, lat, lng FROM places WHERE lat BETWEEN 40 AND 45 AND lng BETWEEN -120 AND -100")
def s03(spark, d):
    return table(spark, d, "places").where("lat BETWEEN 40 AND 45 AND lng BETWEEN -120 AND -100").select("id", "lat", "lng")


@query("f01_in_city", "SELECT id FROM restaurants WHERE lower(city) = 'port calder' AND lower(state) = 'ut'")
def f01(spark, d):
    return table(spark, d, "restaurants").where((F.lower("city") == "port calder") & (F.lower("state") == "ut")).select("id")


@query("f02_has_photo", "SELECT photo_source, count(*) AS n FROM restaurants WHERE photo_url IS NOT NULL AND photo_url <> '' GROUP BY 1")
def f02(spark, d):
    return table(spark, d, "restaurants").where(has("photo_url")).groupBy("photo_source").agg(F.count("*").alias("n"))


@query("f04_nearby", """SELECT * FROM (SELECT id, round(6371 * acos(greatest(-1.0, least(1.0, cos(radians(43.0)) * cos(radians(CAST(latitude AS DOUBLE))) * cos(radians(CAST(longitude AS DOUBLE)) - radians(-114.1)) + sin(radians(43.0)) * sin(radians(CAST(latitude AS DOUBLE)))))), 6) AS distance FROM restaurants WHERE latitude IS NOT NULL AND longitude IS NOT NULL) WHERE distance <= 25""")
def f04(spark, d):
    return rel.nearby(table(spark, d, "restaurants").select("id", "latitude", "longitude"), 43.0, -114.1, 25).select("id", F.round("distance", 6).alias("distance"))


@query("f06_ilike", "SELECT id FROM restaurants WHERE city ILIKE '%calder%'")
def f06(spark, d):
    return table(spark, d, "restaurants").where(C("city").ilike("%calder%")).select("id")


@query("f07_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'refund') OR contains(lower(doc_kind), 'ticket') OR contains(lower(source), 'blog')")
def f07(spark, d):
    any_of = F.lower("text").contains("refund") | F.lower("doc_kind").contains("ticket") | F.lower("source").contains("blog")
    return table(spark, d, "documents").where(any_of).select("doc_id")


@query("f08_in_list", "SELECT id FROM restaurants WHERE source IN ('serpapi', 'bizdata') AND state NOT IN ('UT', 'CA')")
def f08(spark, d):
    return table(spark, d, "restaurants").where(C("source").isin("serpapi", "bizdata") & ~C("state").isin("UT", "CA")).select("id")


@query("f09_in_subquery", "SELECT id FROM restaurants WHERE id IN (SELECT id_a FROM venue_matches WHERE detector = 'exact')")
def f09(spark, d):
    m = table(spark, d, "venue_matches").where("detector = 'exact'").select(C("id_a").alias("id"))
    return table(spark, d, "restaurants").join(m, "id", "left_semi").select("id")


@query("f10_real_names", r"""SELECT id FROM restaurants WHERE trim(coalesce(name, ''), ' ') <> '' AND NOT regexp_matches(trim(name, ' '), '^\d+$') AND lower(trim(name, ' ')) NOT IN ('diner', 'restaurant', 'cafe', 'food', 'bar', 'grill') AND NOT regexp_matches(trim(name, ' '), '^(".+"|''.+'')$') AND NOT regexp_matches(trim(name, ' '), '^[$£€]\d+')""")
def f10(spark, d):
    n = F.trim("name")
    bad = (n == "") | n.rlike(r"^\d+$") | F.lower(n).isin("diner", "restaurant", "cafe", "food", "bar", "grill") | n.rlike("^(\".+\"|'.+')$") | n.rlike(r"^[$£€]\d+")
    return table(spark, d, "restaurants").where(F.coalesce(~bad, F.lit(False))).select("id")


# Words in place types that say what a venue is, in the order they are tried.
RETAIL = ["store", "grocery", "market", "wholesale", "supplier"]
NOT_FOOD = ["salon", "beauty", "hair", "barber", "wax", "nail", "brow", "lash", "church", "school", "museum", "gym", "clinic", "pharmacy", "parking", "bank", "bail bond"]
FOOD = ["restaurant", "cafe", "coffee", "bistro", "diner", "brasserie", "eatery", "pizzeria", "steakhouse", "ice cream", "sandwich", "deli"]


def food_verdict(types: Column) -> Column:
    """'retail', 'other', 'food' or 'none' for a list of place types; null for no list."""
    t = F.transform(types, lambda x: F.lower(F.replace(x, F.lit("_"), F.lit(" "))))
    some = lambda words: F.exists(t, lambda x: x.rlike("|".join(words)))
    tail = F.exists(t, lambda x: F.element_at(F.split(x, r"[\s/\-]+"), -1).isin("bar", "pub", "tavern"))
    return F.when(types.isNull() | (F.size(types) == 0), None).when(some(RETAIL), "retail").when(some(NOT_FOOD), "other").when(some(FOOD) | tail, "food").otherwise("none")


_ANY = lambda words: "len(list_filter(t, lambda x: regexp_matches(x, '" + "|".join(words) + "'))) > 0"


@query("f11_food_types", f"""
WITH p AS (SELECT id, list_transform(list_filter([category], lambda x: x IS NOT NULL), lambda x: lower(replace(x, '_', ' '))) AS t FROM places)
SELECT id, CASE WHEN len(t) = 0 THEN NULL WHEN {_ANY(RETAIL)} THEN 'retail' WHEN {_ANY(NOT_FOOD)} THEN 'other' WHEN {_ANY(FOOD)} OR len(list_filter(t, lambda x: regexp_matches(x, '(^|[ /-])(bar|pub|tavern)$'))) > 0 THEN 'food' ELSE 'none' END AS verdict FROM p""")
def f11(spark, d):
    return table(spark, d, "places").select("id", food_verdict(F.array_compact(F.array("category"))).alias("verdict"))


@query("f14_relevance", r"""SELECT r.id FROM restaurants r WHERE regexp_matches(lower(concat_ws(' ', r.name, array_to_string(r.place_types, ' '), r.description)), '\b(sushi|ramen|izakaya)\b') OR NOT regexp_matches(lower(concat_ws(' ', array_to_string(r.place_types, ' '), r.description)), '\b(pizza|taco|burger)s?\b')""")
def f14(spark, d):
    on = F.lower(F.concat_ws(" ", "name", F.array_join("place_types", " "), "description")).rlike(r"\b(sushi|ramen|izakaya)\b")
    rival = F.lower(F.concat_ws(" ", F.array_join("place_types", " "), "description")).rlike(r"\b(pizza|taco|burger)s?\b")
    return table(spark, d, "restaurants").where(on | ~rival).select("id")


@query("f15_confidence", """WITH n AS (SELECT count(*) AS c FROM restaurants WHERE overture_confidence >= 0.3) SELECT id FROM restaurants, n WHERE CASE WHEN n.c >= 2 THEN overture_confidence >= 0.3 ELSE overture_confidence >= 0.3 OR source IN ('overpass', 'socrata') END""")
def f15(spark, d):
    r = table(spark, d, "restaurants")
    n = r.agg(F.count_if(C("overture_confidence") >= 0.3).alias("c"))
    sure = F.coalesce(C("overture_confidence") >= 0.3, F.lit(False))
    return r.crossJoin(F.broadcast(n)).where(sure | ((C("c") < 2) & C("source").isin("overpass", "socrata"))).select("id")


@query("f16_distance_or_unknown", """SELECT id FROM places WHERE lat IS NULL OR lng IS NULL OR lat = 0 OR lng = 0 OR 12742 * asin(least(1.0, sqrt(power(sin(radians(lat - 43.0) / 2), 2) + cos(radians(43.0)) * cos(radians(lat)) * power(sin(radians(lng + 114.1) / 2), 2)))) <= 50""")
def f16(spark, d):
    km = geo.haversine_asin_km(F.lit(43.0), F.lit(-114.1), C("lat"), C("lng"))
    return table(spark, d, "places").where(~geo.known(C("lat"), C("lng")) | (km <= 50)).select("id")


@query("f19_valid_at", f"SELECT id FROM restaurants WHERE created_at <= TIMESTAMP '{AS_OF}' AND (updated_at IS NULL OR updated_at > TIMESTAMP '{AS_OF}')")
def f19(spark, d):
    now = F.lit(AS_OF).cast("timestamp")
    return table(spark, d, "restaurants").where((C("created_at") <= now) & (C("updated_at").isNull() | (C("updated_at") > now))).select("id")


@query("f22_short_lists", "SELECT id FROM places WHERE coalesce(len(datasets), 0) < 2")
def f22(spark, d):
    return table(spark, d, "places").where(F.coalesce(F.when(C("datasets").isNotNull(), F.size("datasets")), F.lit(0)) < 2).select("id")


@query("f23_map_key_missing", "SELECT id FROM restaurants WHERE field_sources IS NULL OR len(list_filter(map_keys(field_sources), lambda k: k = 'phone')) = 0")
def f23(spark, d):
    return table(spark, d, "restaurants").where(~F.coalesce(F.map_contains_key("field_sources", F.lit("phone")), F.lit(False))).select("id")


@query("f24_junk_rows", "SELECT id FROM restaurants WHERE length(trim(coalesce(name, ''), ' ')) = 1 OR (coalesce(trim(name, ' '), '') = '' AND coalesce(trim(address, ' '), '') = '' AND coalesce(trim(phone, ' '), '') = '' AND coalesce(trim(website_url, ' '), '') = '')")
def f24(spark, d):
    all_blank = text.blank(C("name")) & text.blank(C("address")) & text.blank(C("phone")) & text.blank(C("website_url"))
    return table(spark, d, "restaurants").where((F.length(F.trim(F.coalesce("name", F.lit("")))) == 1) | all_blank).select("id")


@query("f25_incomplete", "SELECT id FROM restaurants r WHERE address IS NULL OR address = '' OR phone IS NULL OR phone = '' OR website_url IS NULL OR website_url = '' OR NOT EXISTS (SELECT 1 FROM cuisine_restaurant c WHERE c.restaurant_id = r.id)")
def f25(spark, d):
    tagged = table(spark, d, "cuisine_restaurant").groupBy(C("restaurant_id").alias("id")).agg(F.lit(True).alias("_t"))
    r = table(spark, d, "restaurants").join(tagged, "id", "left")
    return r.where(~(has("address") & has("phone") & has("website_url")) | C("_t").isNull() | C("address").isNull() | C("phone").isNull() | C("website_url").isNull()).select("id")


@query("f26_near_centers", """WITH c AS (SELECT zip, lat AS c_lat, lng AS c_lng FROM zip_centroids) SELECT DISTINCT p.id FROM places p JOIN c ON abs(p.lat - c.c_lat) <= 0.0045 AND abs(p.lng - c.c_lng) <= 0.0045 / greatest(0.2, cos(radians(c.c_lat)))""")
def f26(spark, d):
    size = 0.0045
    c = table(spark, d, "zip_centroids").select(C("lat").alias("c_lat"), C("lng").alias("c_lng"))
    # the cell is as tall as the box, so three rows of cells hold every match
    near = c.withColumn("cy", F.explode(F.sequence(F.floor(C("c_lat") / size) - 1, F.floor(C("c_lat") / size) + 1)))
    j = table(spark, d, "places").where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("cy", F.floor(C("lat") / size)).join(near, "cy")
    return j.where((F.abs(C("lat") - C("c_lat")) <= size) & (F.abs(C("lng") - C("c_lng")) <= size / F.greatest(F.lit(0.2), F.cos(F.radians("c_lat"))))).select("id").distinct()


# joins


def tagged_venues(spark, d):
    pairs = table(spark, d, "cuisine_restaurant").distinct()
    cuisines = broadcast_if_small(table(spark, d, "cuisines").select(C("id").alias("cuisine_id"), "slug", "category_id", C("name").alias("cuisine")))
    return pairs.join(cuisines, "cuisine_id")


@query("j01_category_counts", "SELECT c.category_id, count(DISTINCT r.id) AS venues FROM cuisines c JOIN cuisine_restaurant x ON x.cuisine_id = c.id JOIN restaurants r ON r.id = x.restaurant_id WHERE r.is_active GROUP BY 1")
def j01(spark, d):
    r = table(spark, d, "restaurants").where("is_active").select(C("id").alias("restaurant_id"))
    return tagged_venues(spark, d).join(r, "restaurant_id").groupBy("category_id").agg(F.countDistinct("restaurant_id").alias("venues"))


@query("j02_has_cuisine", "SELECT id FROM restaurants r WHERE EXISTS (SELECT 1 FROM cuisine_restaurant x JOIN cuisines c ON c.id = x.cuisine_id WHERE x.restaurant_id = r.id AND c.slug = 'thai')")
def j02(spark, d):
    t = tagged_venues(spark, d).where("slug = 'thai'").select(C("restaurant_id").alias("id"))
    return table(spark, d, "restaurants").join(t, "id", "left_semi").select("id")


@query("j03_without_cuisine", "SELECT id FROM restaurants r WHERE NOT EXISTS (SELECT 1 FROM cuisine_restaurant x WHERE x.restaurant_id = r.id)")
def j03(spark, d):
    t = table(spark, d, "cuisine_restaurant").select(C("restaurant_id").alias("id"))
    return table(spark, d, "restaurants").join(t, "id", "left_anti").select("id")


@query("j04_exact_duplicates", "WITH k AS (SELECT name, city, latitude, longitude, min(id) AS keep FROM restaurants WHERE name IS NOT NULL AND city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT k.keep, r.id AS dupe FROM restaurants r JOIN k USING (name, city, latitude, longitude) WHERE r.id > k.keep")
def j04(spark, d):
    return rel.exact_duplicates(table(spark, d, "restaurants").select("id", "name", "city", "latitude", "longitude"), ["name", "city", "latitude", "longitude"], "id")


@query("j05_nested_tags", "SELECT r.id, string_agg(DISTINCT c.slug, ',' ORDER BY c.slug) AS slugs FROM restaurants r LEFT JOIN cuisine_restaurant x ON x.restaurant_id = r.id LEFT JOIN cuisines c ON c.id = x.cuisine_id GROUP BY r.id")
def j05(spark, d):
    tags = tagged_venues(spark, d).groupBy(C("restaurant_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"))
    return table(spark, d, "restaurants").select("id").join(tags, "id", "left")


@query("j15_far_from_zip", """SELECT r.id, CASE WHEN z.zip IS NULL THEN NULL ELSE 12742 * asin(least(1.0, sqrt(power(sin(radians(CAST(r.latitude AS DOUBLE) - z.lat) / 2), 2) + cos(radians(z.lat)) * cos(radians(CAST(r.latitude AS DOUBLE))) * power(sin(radians(CAST(r.longitude AS DOUBLE) - z.lng) / 2), 2)))) > greatest(10.0, 3 * coalesce(z.radius_km, 0)) END AS far FROM restaurants r LEFT JOIN zip_centroids z ON z.zip = substr(r.postal_code, 1, 5)""")
def j15(spark, d):
    z = broadcast_if_small(table(spark, d, "zip_centroids").select(C("zip").alias("_z"), C("lat").alias("z_lat"), C("lng").alias("z_lng"), "radius_km"))
    j = table(spark, d, "restaurants").join(z, F.substring("postal_code", 1, 5) == C("_z"), "left")
    km = geo.haversine_asin_km(C("z_lat"), C("z_lng"), C("latitude").cast("double"), C("longitude").cast("double"))
    return j.select("id", F.when(C("_z").isNotNull(), km > F.greatest(F.lit(10.0), 3 * F.coalesce("radius_km", F.lit(0.0)))).alias("far"))


@query("j17_names_to_ids", "SELECT c.id AS cuisine_id, count(*) AS n FROM (SELECT unnest(place_types) AS t FROM restaurants) p JOIN cuisines c ON lower(replace(c.name, ' ', '-')) || '_restaurant' = p.t GROUP BY 1")
def j17(spark, d):
    names = broadcast_if_small(table(spark, d, "cuisines").select(C("id").alias("cuisine_id"), F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.lit("_restaurant")).alias("t")))
    return table(spark, d, "restaurants").select(F.explode("place_types").alias("t")).join(names, "t").groupBy("cuisine_id").agg(F.count("*").alias("n"))


@query("j18_log_overlap", "SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND date_trunc('minute', c.ts) = date_trunc('minute', e.ts))")
def j18(spark, d):
    e = table(spark, d, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return e.where("event_type = 'view'").join(e.where("event_type = 'click'").select("user_id", "minute"), ["user_id", "minute"], "left_anti").select("event_id")


@query("j19_recent_counts", "SELECT c.c_custkey, count(e.event_id) AS recent FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey AND e.ts > TIMESTAMP '2024-01-16' AND e.ts <= TIMESTAMP '2024-01-30' GROUP BY 1")
def j19(spark, d):
    return rel.recent_counts(table(spark, d, "customer"), table(spark, d, "events"), "c_custkey", "user_id", "ts", "2024-01-30", 14).select("c_custkey", "recent")


@query("j20_registered_observed", "SELECT coalesce(r.slug, 'type:' || o.t) AS command, CASE WHEN o.t IS NULL THEN 'never' WHEN r.slug IS NULL THEN 'unregistered' ELSE 'matched' END AS status FROM (SELECT slug FROM cuisines) r FULL JOIN (SELECT DISTINCT replace(category, '_restaurant', '') AS t FROM places WHERE category IS NOT NULL) o ON o.t = r.slug")
def j20(spark, d):
    o = table(spark, d, "places").where("category IS NOT NULL").select(F.replace("category", F.lit("_restaurant"), F.lit("")).alias("t")).distinct()
    j = table(spark, d, "cuisines").select("slug").join(o, C("slug") == C("t"), "full")
    return j.select(F.coalesce("slug", F.concat(F.lit("type:"), C("t"))).alias("command"), F.when(C("t").isNull(), "never").when(C("slug").isNull(), "unregistered").otherwise("matched").alias("status"))


# aggregates


@query("a01_action_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS total FROM events GROUP BY 1")
def a01(spark, d):
    n = lambda k: F.count_if(C("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), F.count("*").alias("total"))


@query("a03_shared_urls", "SELECT website_url AS url, count(DISTINCT id) AS venues FROM restaurants WHERE website_url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def a03(spark, d):
    return table(spark, d, "restaurants").where("website_url IS NOT NULL").groupBy(C("website_url").alias("url")).agg(F.countDistinct("id").alias("venues")).where("venues >= 2")


@query("a04_city_centers", "SELECT city, state, round(avg(CAST(latitude AS DOUBLE)), 6) AS lat, round(avg(CAST(longitude AS DOUBLE)), 6) AS lng, count(*) AS n FROM restaurants WHERE city NOT IN ('Port Calder', 'Fort Belmaro') GROUP BY 1, 2")
def a04(spark, d):
    r = table(spark, d, "restaurants").where(~C("city").isin("Port Calder", "Fort Belmaro"))
    return r.groupBy("city", "state").agg(F.round(F.avg(C("latitude").cast("double")), 6).alias("lat"), F.round(F.avg(C("longitude").cast("double")), 6).alias("lng"), F.count("*").alias("n"))


@query("a05_city_unrated", "SELECT city, count(*) AS n, count(*) FILTER (WHERE google_rating IS NULL) AS unrated FROM restaurants GROUP BY 1")
def a05(spark, d):
    return table(spark, d, "restaurants").groupBy("city").agg(F.count("*").alias("n"), F.count_if(C("google_rating").isNull()).alias("unrated"))


@query("a06_small_groups", "SELECT count(*) AS cities, CAST(sum(n) AS BIGINT) AS venues FROM (SELECT city, count(*) AS n FROM restaurants WHERE city IS NOT NULL GROUP BY 1) WHERE n <= 5")
def a06(spark, d):
    return table(spark, d, "restaurants").where("city IS NOT NULL").groupBy("city").count().where("count <= 5").agg(F.count("*").alias("cities"), F.sum("count").alias("venues"))


@query("a07_fewest", "SELECT state, count(*) AS n FROM restaurants WHERE state IS NOT NULL GROUP BY 1 ORDER BY n, state LIMIT 5")
def a07(spark, d):
    return table(spark, d, "restaurants").where("state IS NOT NULL").groupBy("state").agg(F.count("*").alias("n")).orderBy("n", "state").limit(5)


@query("a08_distinct", "SELECT count(DISTINCT city) AS cities, count(DISTINCT state) AS states FROM restaurants")
def a08(spark, d):
    return table(spark, d, "restaurants").agg(F.countDistinct("city").alias("cities"), F.countDistinct("state").alias("states"))


FIELDS = ["address", "city", "state", "postal_code", "phone", "website_url", "photo_url", "description"]


@query("a09_coverage", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS has_{f}, round(100.0 * count(*) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') / count(*), 1) AS pct_{f}" for f in FIELDS) + " FROM restaurants")
def a09(spark, d):
    return table(spark, d, "restaurants").agg(F.count("*").alias("n"), *[x for f in FIELDS for x in (F.count_if(has(f)).alias(f"has_{f}"), F.round(100.0 * F.count_if(has(f)) / F.count("*"), 1).alias(f"pct_{f}"))])


@query("a10_by_source", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS fresh FROM live_venues GROUP BY 1")
def a10(spark, d):
    edge = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    return table(spark, d, "live_venues").groupBy("source").agg(F.count("*").alias("n"), F.count_if(C("fetched_at") >= edge).alias("fresh"))


@query("a11_yield", "SELECT event_type, round(coalesce(sum(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 0), 4) AS recent_value, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS recent FROM events GROUP BY 1")
def a11(spark, d):
    new = C("ts") >= F.lit("2024-01-15").cast("timestamp")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.when(new, C("value"))), F.lit(0.0)), 4).alias("recent_value"), F.count_if(new).alias("recent"))


@query("a12_freshness", "SELECT max(updated_at) AS newest, count(*) AS n FROM restaurants")
def a12(spark, d):
    return table(spark, d, "restaurants").agg(F.max("updated_at").alias("newest"), F.count("*").alias("n"))


@query("a14_distribution", "SELECT google_rating IS NOT NULL AS rated, count(*) AS n, min(s) AS low, max(s) AS high, round(avg(s), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(s) END, 6) AS sd, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90 FROM (SELECT *, CAST(popularity_score AS DOUBLE) AS s FROM restaurants) GROUP BY 1")
def a14(spark, d):
    r = table(spark, d, "restaurants").withColumn("s", C("popularity_score").cast("double"))
    p = lambda q: F.round(F.percentile("s", F.lit(q)), 6)
    return r.groupBy(C("google_rating").isNotNull().alias("rated")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("s")), 6).alias("sd"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.9).alias("p90"))


@query("a15_cohort_overlap", "WITH s AS (SELECT min(popularity_score) AS low, max(popularity_score) AS high FROM restaurants WHERE has_award) SELECT count(*) AS n, count(*) FILTER (WHERE popularity_score >= s.low) AS above_low, count(*) FILTER (WHERE popularity_score > s.high) AS above_high FROM restaurants, s WHERE NOT has_award")
def a15(spark, d):
    r = table(spark, d, "restaurants")
    s = r.where("has_award").agg(F.min("popularity_score").alias("low"), F.max("popularity_score").alias("high"))
    return r.where("NOT has_award").crossJoin(F.broadcast(s)).agg(F.count("*").alias("n"), F.count_if(C("popularity_score") >= C("low")).alias("above_low"), F.count_if(C("popularity_score") > C("high")).alias("above_high"))


@query("a16_activation", "SELECT count(*) FILTER (WHERE google_rating > 0) AS quality, count(*) FILTER (WHERE has_award) AS award, count(*) FILTER (WHERE website_clicks_count > 0) AS clicks, count(*) FILTER (WHERE pageviews_count > 0) AS views FROM restaurants")
def a16(spark, d):
    return table(spark, d, "restaurants").agg(F.count_if(C("google_rating") > 0).alias("quality"), F.count_if("has_award").alias("award"), F.count_if(C("website_clicks_count") > 0).alias("clicks"), F.count_if(C("pageviews_count") > 0).alias("views"))


@query("a17_many_cities", "SELECT lower(trim(name, ' ')) AS name_key, count(*) AS n, count(DISTINCT lower(trim(city, ' '))) AS cities, min(id) AS first_id FROM restaurants GROUP BY 1 HAVING count(DISTINCT lower(trim(city, ' '))) > 1")
def a17(spark, d):
    return table(spark, d, "restaurants").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("city"))).alias("cities"), F.min("id").alias("first_id")).where("cities > 1")


@query("a18_runtimes", "SELECT event_type, round(min(value), 4) AS low, round(avg(value), 4) AS mean, round(max(value), 4) AS high FROM events GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.min("value"), 4).alias("low"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("high"))


@query("a19_categories", "SELECT doc_kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, doc_kind) AS position FROM documents GROUP BY 1")
def a19(spark, d):
    g = table(spark, d, "documents").groupBy("doc_kind").agg(F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(C("n").desc(), "doc_kind")))


@query("a20_missing_most", "SELECT id, missing FROM (SELECT id, " + " + ".join(f"(CASE WHEN {f} IS NOT NULL AND {f} <> '' THEN 0 ELSE 1 END)" for f in FIELDS) + " AS missing FROM restaurants) ORDER BY missing DESC, id LIMIT 20")
def a20(spark, d):
    missing = sum((F.when(has(f), 0).otherwise(1) for f in FIELDS), F.lit(0))
    return table(spark, d, "restaurants").select("id", missing.alias("missing")).orderBy(C("missing").desc(), "id").limit(20)


# ranks, sorts, pages


@query("w01_rank", "SELECT id, row_number() OVER (ORDER BY popularity_score DESC, id) AS position FROM restaurants")
def w01(spark, d):
    r = table(spark, d, "restaurants").select("id", "popularity_score")
    return rel.ranked(r, "position", C("popularity_score").desc(), C("id")).select("id", "position")


@query("w02_rank_change", "SELECT id, CAST(o AS BIGINT) - CAST(n AS BIGINT) AS rank_change FROM (SELECT id, row_number() OVER (ORDER BY popularity_score DESC, id) AS o, row_number() OVER (ORDER BY total_engagement DESC, id) AS n FROM restaurants)")
def w02(spark, d):
    r = table(spark, d, "restaurants").select("id", "popularity_score", "total_engagement")
    old = rel.ranked(r, "o", C("popularity_score").desc(), C("id")).select("id", "o")
    new = rel.ranked(r, "n", C("total_engagement").desc(), C("id")).select("id", "n")
    return old.join(new, "id").select("id", (C("o") - C("n")).cast("long").alias("rank_change"))


@query("w03_first_per_name", "SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name, ' ')) ORDER BY popularity_score DESC, id) AS k FROM restaurants WHERE name IS NOT NULL) WHERE k = 1")
def w03(spark, d):
    r = table(spark, d, "restaurants").where("name IS NOT NULL").select("id", "name", "popularity_score")
    return rel.first_per_key(r, F.lower(F.trim("name")), C("popularity_score").desc(), C("id")).select("id", "name")


@query("w04_cascade", "WITH t AS (SELECT id, CASE WHEN lower(trim(city, ' ')) = 'fort belmaro' AND has_award THEN 1 WHEN has_award AND photo_url IS NOT NULL THEN 2 ELSE 3 END AS tier FROM restaurants) SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)")
def w04(spark, d):
    tier = F.when((F.lower(F.trim("city")) == "fort belmaro") & C("has_award"), 1).when(C("has_award") & C("photo_url").isNotNull(), 2).otherwise(3)
    t = table(spark, d, "restaurants").select("id", tier.alias("tier"))
    return t.crossJoin(F.broadcast(t.agg(F.min("tier").alias("best")))).where("tier = best").select("id", "tier")


@query("w05_page", "SELECT id, row_number() OVER (ORDER BY popularity_score DESC, id) AS position, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS last_page FROM restaurants QUALIFY position BETWEEN 51 AND 100")
def w05(spark, d):
    r = table(spark, d, "restaurants").select("id", "popularity_score")
    return rel.page(r, 2, 50, C("popularity_score").desc(), C("id")).select("id", "position", "total", C("last_page").cast("long").alias("last_page"))


_DECAY = f"CAST(popularity_score AS DOUBLE) * greatest(0.5, 1.0 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400e6 / 90)"


@query("o01_decayed", f"SELECT id, round(CASE WHEN updated_at IS NOT NULL THEN {_DECAY} END, 6) AS decayed FROM restaurants")
def o01(spark, d):
    return table(spark, d, "restaurants").select("id", F.round(decayed(C("popularity_score"), C("updated_at"), AS_OF), 6).alias("decayed"))


@query("o02_trending", f"SELECT r.id, round({_DECAY} + 0.01 * coalesce(e.n, 0), 6) AS trending FROM restaurants r LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-16' AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1) e ON e.user_id = r.id WHERE r.updated_at IS NOT NULL")
def o02(spark, d):
    r = rel.recent_counts(table(spark, d, "restaurants").where("updated_at IS NOT NULL"), table(spark, d, "events"), "id", "user_id", "ts", "2024-01-30", 14)
    return r.select("id", F.round(decayed(C("popularity_score"), C("updated_at"), AS_OF) + 0.01 * C("recent"), 6).alias("trending"))


@query("o04_credible_rating", "SELECT id, CASE WHEN google_review_count < 20 THEN CAST(google_rating AS DOUBLE) - 10 ELSE CAST(google_rating AS DOUBLE) END AS sort_rating FROM restaurants")
def o04(spark, d):
    r = C("google_rating").cast("double")
    return table(spark, d, "restaurants").select("id", F.when(C("google_review_count") < 20, r - 10).otherwise(r).alias("sort_rating"))


@query("o07_nulls_last", "SELECT id, row_number() OVER (ORDER BY yelp_rating DESC NULLS LAST, popularity_score DESC, name NULLS FIRST, id) AS position FROM restaurants")
def o07(spark, d):
    r = table(spark, d, "restaurants").select("id", "yelp_rating", "popularity_score", "name")
    return rel.ranked(r, "position", C("yelp_rating").desc_nulls_last(), C("popularity_score").desc(), C("name").asc_nulls_first(), C("id")).select("id", "position")


@query("o08_completeness", "SELECT id, " + " + ".join(f"(CASE WHEN {f} IS NOT NULL AND {f} <> '' THEN 1 ELSE 0 END)" for f in FIELDS) + " AS filled FROM restaurants")
def o08(spark, d):
    return table(spark, d, "restaurants").select("id", sum((F.when(has(f), 1).otherwise(0) for f in FIELDS), F.lit(0)).alias("filled"))


@query("o12_stalest_cities", "SELECT city, max(updated_at) AS newest, count(*) FILTER (WHERE google_rating IS NULL) AS need FROM restaurants WHERE city IS NOT NULL GROUP BY 1 ORDER BY newest ASC NULLS FIRST, need DESC, city LIMIT 25")
def o12(spark, d):
    g = table(spark, d, "restaurants").where("city IS NOT NULL").groupBy("city").agg(F.max("updated_at").alias("newest"), F.count_if(C("google_rating").isNull()).alias("need"))
    return g.orderBy(C("newest").asc_nulls_first(), C("need").desc(), "city").limit(25)


@query("o15_resume_cursor", "SELECT DISTINCT city || '|' || state AS key FROM restaurants WHERE city || '|' || state > 'Jorvanmere|TX' ORDER BY key LIMIT 30")
def o15(spark, d):
    k = table(spark, d, "restaurants").select(F.concat("city", F.lit("|"), "state").alias("key")).where("key > 'Jorvanmere|TX'").distinct()
    return k.orderBy("key").limit(30)


@query("o16_latest_version", "SELECT source_name, max(version) AS version FROM (SELECT split_part(v, ':', 1) AS source_name, split_part(v, ':', 2) AS version FROM (SELECT unnest(map_values(field_sources)) AS v FROM restaurants)) GROUP BY 1")
def o16(spark, d):
    v = table(spark, d, "restaurants").select(F.explode(F.map_values("field_sources")).alias("v")).select(F.split_part("v", F.lit(":"), F.lit(1)).alias("source_name"), F.split_part("v", F.lit(":"), F.lit(2)).alias("version"))
    # numbers in a version compare as numbers
    parts = F.transform(F.split("version", "[^0-9]+"), lambda x: x.cast("int"))
    return v.groupBy("source_name").agg(F.max_by("version", parts).alias("version"))


# write plans


@query("k02_upsert", "WITH b AS (SELECT id, name, updated_at, 0 AS n FROM (SELECT id, any_value(name) AS name, any_value(updated_at) AS updated_at FROM restaurants GROUP BY id) UNION ALL SELECT restaurant_id, 'doc', max(published_at), 1 FROM documents WHERE restaurant_id IS NOT NULL GROUP BY 1) SELECT id, name, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, n DESC) AS k FROM b) WHERE k = 1")
def k02(spark, d):
    old = table(spark, d, "restaurants").select("id", "name", "updated_at")
    new = table(spark, d, "documents").where("restaurant_id IS NOT NULL").groupBy(C("restaurant_id").cast("long").alias("id")).agg(F.max("published_at").alias("updated_at")).select("id", F.lit("doc").alias("name"), "updated_at")
    return rel.upsert(old, new, ["id"], "updated_at").select("id", "name", "updated_at")


@query("k03_batch_update", "SELECT r.id, coalesce(u.n, r.pageviews_count) AS pageviews_count FROM restaurants r LEFT JOIN (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1) u ON u.user_id = r.id")
def k03(spark, d):
    u = table(spark, d, "events").groupBy(C("user_id").alias("id")).agg(F.count("*").cast("int").alias("pageviews_count"))
    return rel.patched(table(spark, d, "restaurants").select("id", "pageviews_count"), u, "id", ["pageviews_count"])


@query("k05_upsert_near", """SELECT p.id AS place_id, min(r.id) AS restaurant_id FROM places p JOIN restaurants r ON r.name = p.name AND abs(CAST(r.latitude AS DOUBLE) - p.lat) <= 0.01 AND abs(CAST(r.longitude AS DOUBLE) - p.lng) <= 0.01 AND 12742 * asin(least(1.0, sqrt(power(sin(radians(p.lat - CAST(r.latitude AS DOUBLE)) / 2), 2) + cos(radians(CAST(r.latitude AS DOUBLE))) * cos(radians(p.lat)) * power(sin(radians(p.lng - CAST(r.longitude AS DOUBLE)) / 2), 2)))) <= 0.2 GROUP BY 1""")
def k05(spark, d):
    # name and cell together are the key: a chain's branches do not all meet in one task
    at = lambda c: F.floor(C(c) / 0.01)
    r = table(spark, d, "restaurants").select("id", "name", C("latitude").cast("double").alias("r_lat"), C("longitude").cast("double").alias("r_lng")).withColumn("cy", F.explode(F.sequence(at("r_lat") - 1, at("r_lat") + 1))).withColumn("cx", F.explode(F.sequence(at("r_lng") - 1, at("r_lng") + 1)))
    p = table(spark, d, "places").select(C("id").alias("place_id"), "name", "lat", "lng").withColumn("cy", at("lat")).withColumn("cx", at("lng"))
    ok = (F.abs(C("r_lat") - C("lat")) <= 0.01) & (F.abs(C("r_lng") - C("lng")) <= 0.01) & (geo.haversine_asin_km(C("r_lat"), C("r_lng"), C("lat"), C("lng")) <= 0.2)
    return p.join(r, ["name", "cy", "cx"]).where(ok).groupBy("place_id").agg(F.min("id").alias("restaurant_id"))


@query("k07_toggle", "WITH a AS (SELECT DISTINCT restaurant_id, cuisine_id FROM cuisine_restaurant), b AS (SELECT DISTINCT id AS restaurant_id, CAST(1 AS BIGINT) AS cuisine_id FROM restaurants WHERE has_award) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def k07(spark, d):
    a = table(spark, d, "cuisine_restaurant").select("restaurant_id", "cuisine_id").distinct().withColumn("side", F.lit(1))
    b = table(spark, d, "restaurants").where("has_award").select(C("id").alias("restaurant_id"), F.lit(1).cast("long").alias("cuisine_id"), F.lit(2).alias("side"))
    return a.unionByName(b).groupBy("restaurant_id", "cuisine_id").agg(F.sum("side").alias("s")).where("s <> 3").drop("s")


@query("k08_delete", "SELECT x.restaurant_id, x.cuisine_id FROM cuisine_restaurant x WHERE x.restaurant_id NOT IN (SELECT id FROM restaurants WHERE NOT is_active)")
def k08(spark, d):
    gone = table(spark, d, "restaurants").where("NOT is_active").select(C("id").alias("restaurant_id"))
    return table(spark, d, "cuisine_restaurant").join(gone, "restaurant_id", "left_anti").select("restaurant_id", "cuisine_id")


@query("k11_snapshot_pages", "SELECT id, CAST(floor((row_number() OVER (ORDER BY popularity_score DESC, id) - 1) / 20) AS BIGINT) + 1 AS page FROM restaurants")
def k11(spark, d):
    r = rel.ranked(table(spark, d, "restaurants").select("id", "popularity_score"), "position", C("popularity_score").desc(), C("id"))
    return r.select("id", (F.floor((C("position") - 1) / 20) + 1).alias("page"))
