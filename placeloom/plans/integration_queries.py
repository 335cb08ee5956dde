"""Folding, correcting, scheduling and exporting over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import integration, matching, relational
from placeloom.plans.relational_queries import AS_OF
from placeloom.plans.venue_queries import _NK, P10, km_sql
from placeloom.session import broadcast_if_small, table

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


@query("f12_untyped_names", r"SELECT id, regexp_extract(lower(name), '\b(salon|barber|church|gym|clinic|bank|parking)\b', 1) AS word FROM places WHERE category IS NULL AND name IS NOT NULL")
def f12(spark, d):
    return table(spark, d, "places").where("category IS NULL AND name IS NOT NULL").select("id", F.regexp_extract(F.lower("name"), r"\b(salon|barber|church|gym|clinic|bank|parking)\b", 1).alias("word"))


@query("f13_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN category IS NULL AND trim(coalesce(name, ''), ' ') = '' THEN 'nothing known' WHEN category IS NULL THEN 'no category' WHEN operating_status = 'closed' THEN 'closed: ' || category END AS reason FROM places) GROUP BY 1")
def f13(spark, d):
    reason = F.when(C("category").isNull() & text.blank(C("name")), "nothing known").when(C("category").isNull(), "no category").when(C("operating_status") == "closed", F.concat(F.lit("closed: "), C("category")))
    return table(spark, d, "places").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f17_bounded", "SELECT id, popularity_score FROM restaurants WHERE popularity_score >= 0.3 ORDER BY popularity_score DESC, id LIMIT 150")
def f17(spark, d):
    return table(spark, d, "restaurants").where("popularity_score >= 0.3").orderBy(C("popularity_score").desc(), "id").limit(150).select("id", "popularity_score")


@query("f20_published", f"SELECT doc_kind, count(*) AS n, max(n_chars) AS longest FROM documents WHERE published_at IS NOT NULL AND published_at <= TIMESTAMP '{AS_OF}' GROUP BY 1")
def f20(spark, d):
    return table(spark, d, "documents").where(C("published_at") <= F.lit(AS_OF).cast("timestamp")).groupBy("doc_kind").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("f21_cooldowns", f"SELECT id FROM restaurants WHERE CASE WHEN coalesce(photo_source, '') = 'google' THEN updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ELSE updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY END")
def f21(spark, d):
    now = F.lit(AS_OF).cast("timestamp")
    short = F.coalesce("photo_source", F.lit("")) == "google"
    return table(spark, d, "restaurants").where(F.when(short, C("updated_at") < now - F.expr("INTERVAL 30 DAYS")).otherwise(C("updated_at") < now - F.expr("INTERVAL 180 DAYS"))).select("id")


@query("f27_pattern_list", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(source, ''), '(forktalk|blog|\.invalid$)')")
def f27(spark, d):
    return table(spark, d, "documents").where(~F.coalesce("source", F.lit("")).rlike(r"(forktalk|blog|\.invalid$)")).select("doc_id")


def live(spark, d):
    return table(spark, d, "live_venues").distinct().select(C("id").alias("live_id"), F.lower(F.trim("name")).alias("n"), "lat", "lng", text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("city")).alias("c"), text.name_key(C("name")).alias("k"))


def keyed(df):
    return df.withColumn("phone_city", F.concat_ws("|", "p", "c")).withColumn("phone_city", F.when(C("p").isNotNull() & C("c").isNotNull(), C("phone_city"))).withColumn("name_city", F.when((C("k") != "") & C("c").isNotNull(), F.concat_ws("|", "k", "c")))


def stored(spark, d):
    return table(spark, d, "restaurants").select(C("id").alias("stored_id"), F.lower(F.trim("name")).alias("n"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"), text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("city")).alias("c"), text.name_key(C("name")).alias("k"))


_KEYED = f"""
l AS (SELECT DISTINCT id AS live_id, CASE WHEN {P10} IS NOT NULL AND city IS NOT NULL THEN {P10} || '|' || lower(trim(city, ' ')) END AS phone_city, CASE WHEN {_NK} <> '' AND city IS NOT NULL THEN {_NK} || '|' || lower(trim(city, ' ')) END AS name_city FROM live_venues),
s AS (SELECT id AS stored_id, CASE WHEN {P10} IS NOT NULL AND city IS NOT NULL THEN {P10} || '|' || lower(trim(city, ' ')) END AS phone_city, CASE WHEN {_NK} <> '' AND city IS NOT NULL THEN {_NK} || '|' || lower(trim(city, ' ')) END AS name_city FROM restaurants),
m AS (SELECT live_id, stored_id, 'phone_city' AS rule, 0 AS i FROM l JOIN s USING (phone_city) UNION ALL SELECT live_id, stored_id, 'name_city', 1 FROM l JOIN s USING (name_city))
"""


@query("j06_key_precedence", f"WITH {_KEYED} SELECT live_id, stored_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY live_id ORDER BY i, stored_id) AS k FROM m) WHERE k = 1")
def j06(spark, d):
    return integration.first_key_match(keyed(live(spark, d)), keyed(stored(spark, d)), ["phone_city", "name_city"])


@query("j09_folded")
def j09(spark, d):
    return integration.fold(keyed(live(spark, d)), keyed(stored(spark, d)), ["phone_city", "name_city"])


@query("j10_not_closed", f"SELECT DISTINCT id FROM live_venues v WHERE NOT EXISTS (SELECT 1 FROM restaurants r WHERE NOT r.is_active AND {P10.replace('phone', 'r.phone')} = {P10.replace('phone', 'v.phone')} AND lower(trim(r.city, ' ')) = lower(trim(v.city, ' ')))")
def j10(spark, d):
    closed = table(spark, d, "restaurants").where("NOT is_active").select(text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("city")).alias("c"))
    return live(spark, d).join(closed, ["p", "c"], "left_anti").select(C("live_id").alias("id")).distinct()


@query("j11_award_nearby")
def j11(spark, d):
    r = table(spark, d, "restaurants")
    awarded = r.where("has_award").select(C("id").alias("stored_id"), F.lower(F.trim("name")).alias("n"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    others = r.where("NOT has_award").select(C("id").alias("live_id"), F.lower(F.trim("name")).alias("n"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    return integration.nearby_alike(others, awarded, 1.5, 70.0).select(C("live_id").alias("id"), C("stored_id").alias("awarded_id"))


@query("j13_grid_clusters", "SELECT CAST(floor(lat / 0.2) AS BIGINT) AS cy, CAST(floor(lng / 0.2) AS BIGINT) AS cx, count(*) AS n, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng FROM places WHERE lat <> 0 AND lng <> 0 GROUP BY 1, 2")
def j13(spark, d):
    y, x = geo.cell(C("lat"), C("lng"), 0.2)
    return table(spark, d, "places").where("lat <> 0 AND lng <> 0").groupBy(y.alias("cy"), x.alias("cx")).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"))


@query("j14_nearest_of_area", f"SELECT id, zip FROM (SELECT p.id, z.zip, row_number() OVER (PARTITION BY p.id ORDER BY {km_sql('z.lat', 'z.lng', 'p.lat', 'p.lng')}, z.zip) AS k FROM places p JOIN zip_centroids z ON substr(z.zip, 1, 3) = substr(p.postcode, 1, 3) WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL) WHERE k = 1")
def j14(spark, d):
    z = broadcast_if_small(table(spark, d, "zip_centroids").select("zip", F.left("zip", F.lit(3)).alias("area"), C("lat").alias("z_lat"), C("lng").alias("z_lng")))
    p = table(spark, d, "places").where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("area", F.substring("postcode", 1, 3)).join(z, "area")
    return p.groupBy("id").agg(F.min_by("zip", F.struct(geo.haversine_asin_km(C("z_lat"), C("z_lng"), C("lat"), C("lng")).alias("km"), C("zip"))).alias("zip"))


@query("k04_upsert_actions", f"WITH {_KEYED}, b AS (SELECT live_id, min(i) AS i FROM m GROUP BY 1) SELECT CASE WHEN b.i IS NULL THEN 'insert' WHEN b.i = 0 THEN 'update by phone_city' ELSE 'update by name_city' END AS action, count(*) AS n FROM (SELECT DISTINCT live_id FROM l) x LEFT JOIN b USING (live_id) GROUP BY 1")
def k04(spark, d):
    x = live(spark, d).select("live_id").distinct()
    m = integration.first_key_match(keyed(live(spark, d)), keyed(stored(spark, d)), ["phone_city", "name_city"])
    return x.join(m, "live_id", "left").groupBy(F.when(C("rule").isNull(), "insert").otherwise(F.concat(F.lit("update by "), C("rule"))).alias("action")).agg(F.count("*").alias("n"))


@query("k10_export_files", "SELECT CAST(floor((row_number() OVER (ORDER BY popularity_score DESC, id) - 1) / 500) AS BIGINT) AS file, id, '/venues/' || slug AS url FROM restaurants WHERE is_active")
def k10(spark, d):
    r = relational.ranked(table(spark, d, "restaurants").where("is_active").select("id", "slug", "popularity_score"), "position", C("popularity_score").desc(), C("id"))
    return r.select(F.floor((C("position") - 1) / 500).alias("file"), "id", F.concat(F.lit("/venues/"), "slug").alias("url"))


@query("m05_filled_fields", f"""
WITH p AS (SELECT t AS ph, min(id) AS pid FROM (SELECT id, {P10.replace('phone', 'u')} AS t FROM (SELECT id, unnest(phones) AS u FROM places)) WHERE t IS NOT NULL GROUP BY 1),
i AS (SELECT r.id, q.street, q.postcode FROM (SELECT id, {P10} AS ph FROM restaurants) r JOIN p USING (ph) JOIN places q ON q.id = p.pid)
SELECT r.id, CASE WHEN trim(coalesce(r.address, ''), ' ') = '' AND trim(coalesce(i.street, ''), ' ') <> '' THEN i.street ELSE r.address END AS address, CASE WHEN trim(coalesce(r.postal_code, ''), ' ') = '' AND trim(coalesce(i.postcode, ''), ' ') <> '' THEN i.postcode ELSE r.postal_code END AS postal_code,
  coalesce(len(map_keys(r.field_sources)), 0) + CASE WHEN trim(coalesce(r.address, ''), ' ') = '' AND trim(coalesce(i.street, ''), ' ') <> '' AND NOT coalesce(list_contains(map_keys(r.field_sources), 'address'), false) THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(r.postal_code, ''), ' ') = '' AND trim(coalesce(i.postcode, ''), ' ') <> '' AND NOT coalesce(list_contains(map_keys(r.field_sources), 'postal_code'), false) THEN 1 ELSE 0 END AS notes
FROM restaurants r LEFT JOIN i USING (id)""")
def m05(spark, d):
    phones = table(spark, d, "places").select("id", "street", "postcode", F.explode("phones").alias("u")).withColumn("ph", text.last_ten_digits(C("u"))).where("ph IS NOT NULL")
    best = phones.groupBy("ph").agg(F.min(F.struct("id", "street", "postcode")).alias("b")).select("ph", "b.street", "b.postcode")
    r = table(spark, d, "restaurants")
    i = r.select("id", text.last_ten_digits(C("phone")).alias("ph")).join(best, "ph").select("id", C("street").alias("address"), C("postcode").alias("postal_code"))
    f = integration.filled_from(r, i, "id", ["address", "postal_code"], F.lit("directory"))
    return f.select("id", "address", "postal_code", F.coalesce(F.when(C("field_sources").isNotNull(), F.size("field_sources")), F.lit(0)).cast("long").alias("notes"))


@query("m11_proximity_groups")
def m11(spark, d):
    r = table(spark, d, "restaurants").where("name IS NOT NULL AND city IS NOT NULL").select(C("id").alias("ord"), F.concat_ws("|", F.lower(F.trim("name")), F.lower(F.trim("city"))).alias("k"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    near = matching.grid_pairs(r, r.select(C("ord").alias("o2"), C("k").alias("k2"), "lat", "lng"), 0.15).where("ord < o2 AND k = k2")
    return matching.greedy_anchors(r.select("ord"), near.select(C("ord").alias("a"), C("o2").alias("b"))).where("ord <> anchor").select(C("anchor").alias("keep"), C("ord").alias("dupe"))


@query("m16_yield", f"WITH {_KEYED}, b AS (SELECT DISTINCT live_id FROM m) SELECT count(*) AS seen, count(b.live_id) AS matched, count(*) - count(b.live_id) AS created FROM (SELECT DISTINCT live_id FROM l) x LEFT JOIN b USING (live_id)")
def m16(spark, d):
    m = integration.first_key_match(keyed(live(spark, d)), keyed(stored(spark, d)), ["phone_city", "name_city"])
    x = live(spark, d).select("live_id").distinct().join(m, "live_id", "left")
    return x.agg(F.count("*").alias("seen"), F.count("rule").alias("matched"), F.count_if(C("rule").isNull()).alias("created"))


@query("o03_nearest_sort", f"SELECT id, row_number() OVER (ORDER BY round({km_sql('43.0', '-114.1', 'lat', 'lng')}, 6) NULLS LAST, id) AS position FROM places")
def o03(spark, d):
    p = table(spark, d, "places").select("id", F.round(geo.haversine_asin_km(F.lit(43.0), F.lit(-114.1), C("lat"), C("lng")), 6).alias("km"))
    return relational.ranked(p, "position", C("km").asc_nulls_last(), C("id")).select("id", "position")


@query("o09_boolean_first", "SELECT id, row_number() OVER (ORDER BY (photo_url IS NOT NULL), updated_at NULLS FIRST, coalesce(popularity_score, 0) DESC, id) AS position FROM restaurants")
def o09(spark, d):
    r = table(spark, d, "restaurants").select("id", C("photo_url").isNotNull().alias("has"), "updated_at", F.coalesce("popularity_score", F.lit(0)).alias("s"))
    return relational.ranked(r, "position", C("has"), C("updated_at").asc_nulls_first(), C("s").desc(), C("id")).select("id", "position")


@query("o10_oldest_checked", "SELECT id, coalesce(updated_at, created_at) AS checked FROM restaurants ORDER BY checked, id LIMIT 40")
def o10(spark, d):
    return table(spark, d, "restaurants").select("id", F.coalesce("updated_at", "created_at").alias("checked")).orderBy("checked", "id").limit(40)


@query("o11_tuple_top", "SELECT id FROM (SELECT id, updated_at IS NULL AS never, (CASE WHEN phone IS NULL THEN 1 ELSE 0 END) + (CASE WHEN website_url IS NULL THEN 1 ELSE 0 END) AS missing, popularity_score FROM restaurants) ORDER BY never DESC, missing DESC, popularity_score DESC, id LIMIT 60")
def o11(spark, d):
    r = table(spark, d, "restaurants").select("id", C("updated_at").isNull().alias("never"), (C("phone").isNull().cast("int") + C("website_url").isNull().cast("int")).alias("missing"), "popularity_score")
    return r.orderBy(C("never").desc(), C("missing").desc(), C("popularity_score").desc(), "id").limit(60).select("id")


@query("d09_city_far_from_pin", f"""
WITH c AS (SELECT lower(trim(city, ' ')) AS ck, count(*) AS n, median(round(CAST(latitude AS DOUBLE), 3)) AS c_lat, median(round(CAST(longitude AS DOUBLE), 3)) AS c_lng FROM restaurants WHERE city IS NOT NULL AND latitude <> 0 AND longitude <> 0 GROUP BY 1)
SELECT r.id, CASE WHEN c.n < 5 THEN 'unknown' WHEN {km_sql('c.c_lat', 'c.c_lng', 'CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)')} > 50 THEN 'far' ELSE 'near' END AS verdict FROM restaurants r JOIN c ON c.ck = lower(trim(r.city, ' ')) WHERE r.latitude <> 0 AND r.longitude <> 0""")
def d09(spark, d):
    r = table(spark, d, "restaurants").where("city IS NOT NULL AND latitude <> 0 AND longitude <> 0").select("id", F.lower(F.trim("city")).alias("ck"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    # a median counts distinct values: at three decimals a city has some thousands, however many rows
    c = r.groupBy("ck").agg(F.count("*").alias("n"), F.median(F.round("lat", 3)).alias("c_lat"), F.median(F.round("lng", 3)).alias("c_lng"))
    far = geo.haversine_asin_km(C("c_lat"), C("c_lng"), C("lat"), C("lng")) > 50
    return r.join(c, "ck").select("id", F.when(C("n") < 5, "unknown").when(far, "far").otherwise("near").alias("verdict"))


@query("d12_missed_hours", """
WITH b AS (SELECT event_type, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events GROUP BY 1),
e AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b),
o AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT e.event_type, count(*) AS expected, count(*) FILTER (WHERE o.n IS NULL) AS missed, count(*) FILTER (WHERE o.n > 6) AS crowded FROM e LEFT JOIN o USING (event_type, hour) GROUP BY 1""")
def d12(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"))
    due = e.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("z")).select("event_type", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    seen = e.groupBy("event_type", "hour").agg(F.count("*").alias("n"))
    return due.join(seen, ["event_type", "hour"], "left").groupBy("event_type").agg(F.count("*").alias("expected"), F.count_if(C("n").isNull()).alias("missed"), F.count_if(C("n") > 6).alias("crowded"))


@query("d12_gaps", "SELECT event_type, max(gap) AS longest_s, count(*) FILTER (WHERE gap > 3600) AS stops FROM (SELECT event_type, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6) AS BIGINT) AS gap FROM events) GROUP BY 1")
def d12g(spark, d):
    # gaps are taken within a type and day, then between a day's first event and the last one of the days before
    e = table(spark, d, "events").select("event_type", "event_id", F.to_date("ts").alias("day"), F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    inside = e.withColumn("gap", F.floor((C("us") - F.lag("us").over(Window.partitionBy("event_type", "day").orderBy("us", "event_id"))) / 1e6))
    days = inside.groupBy("event_type", "day").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("gap").alias("gap"), F.count_if(C("gap") > 3600).alias("stops"))
    # one row for each type and day
    between = days.withColumn("edge", F.floor((C("first") - F.lag("last").over(Window.partitionBy("event_type").orderBy("day"))) / 1e6))
    return between.groupBy("event_type").agg(F.max(F.greatest("gap", "edge")).alias("longest_s"), F.sum(C("stops") + F.when(C("edge") > 3600, 1).otherwise(0)).alias("stops"))


@query("s14_log_lines", "SELECT event_type AS command, date_trunc('minute', ts) AS minute, count(*) AS fires FROM events GROUP BY 1, 2")
def s14(spark, d):
    # raw lines as a log file holds them, read back by pattern
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] run: "), "event_type", F.lit(" user="), C("user_id").cast("string"))
    raw = table(spark, d, "events").select(line.alias("value"))
    p = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d):\d\d\] run: (\w+)"
    rows = raw.select(F.regexp_extract("value", p, 2).alias("command"), F.to_timestamp(F.regexp_extract("value", p, 1), "yyyy-MM-dd HH:mm").alias("minute"))
    return rows.groupBy("command", "minute").agg(F.count("*").alias("fires"))


@query("x25_later_of_two", "SELECT id, greatest(created_at, updated_at) AS last_touched FROM restaurants")
def x25(spark, d):
    return table(spark, d, "restaurants").select("id", F.greatest("created_at", "updated_at").alias("last_touched"))


@query("x26_file_names", r"SELECT id, replace(regexp_extract(photo_url, '/([^/?#]+)(\?[^#]*)?(#.*)?$', 1), '_', ' ') AS file FROM restaurants WHERE photo_url IS NOT NULL")
def x26(spark, d):
    return table(spark, d, "restaurants").where("photo_url IS NOT NULL").select("id", F.replace(F.regexp_extract("photo_url", r"/([^/?#]+)(\?[^#]*)?(#.*)?$", 1), F.lit("_"), F.lit(" ")).alias("file"))


@query("x31_sanitized", f"SELECT DISTINCT id, CASE WHEN length(trim(address, ' ')) >= 8 AND contains(trim(address, ' '), ' ') THEN trim(address, ' ') END AS address, CASE WHEN regexp_matches(photo_url, '^https?://[^/]') THEN photo_url END AS photo_url, CASE WHEN google_rating > 0 AND google_rating <= 5 THEN CAST(google_rating AS DOUBLE) END AS google_rating, {P10} AS phone FROM live_venues")
def x31(spark, d):
    a = F.trim("address")
    return table(spark, d, "live_venues").select("id", F.when((F.length(a) >= 8) & a.contains(" "), a).alias("address"), F.when(C("photo_url").rlike("^https?://[^/]"), C("photo_url")).alias("photo_url"), F.when((C("google_rating") > 0) & (C("google_rating") <= 5), C("google_rating").cast("double")).alias("google_rating"), text.last_ten_digits(C("phone")).alias("phone")).distinct()


@query("x32_types_to_tags", "SELECT c.slug, count(*) AS n FROM (SELECT regexp_replace(unnest(place_types), '_(restaurant|cafe|bar)$', '') AS t FROM restaurants) p JOIN cuisines c ON c.slug = p.t GROUP BY 1")
def x32(spark, d):
    t = table(spark, d, "restaurants").select(F.explode("place_types").alias("t")).select(F.regexp_replace("t", "_(restaurant|cafe|bar)$", "").alias("slug"))
    return t.join(broadcast_if_small(table(spark, d, "cuisines").select("slug")), "slug").groupBy("slug").agg(F.count("*").alias("n"))


@query("x34_text_names_venue", f"SELECT d.doc_id, contains(trim(regexp_replace(regexp_replace(lower(d.text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' '), {_NK.replace('name', 'r.name')}) AS named FROM documents d JOIN restaurants r ON r.id = d.restaurant_id")
def x34(spark, d):
    r = table(spark, d, "restaurants").select(C("id").alias("restaurant_id"), text.name_key(C("name")).alias("k"))
    return table(spark, d, "documents").select("doc_id", C("restaurant_id").cast("long").alias("restaurant_id"), "text").join(r, "restaurant_id").select("doc_id", F.contains(text.name_key(C("text")), C("k")).alias("named"))


@query("x37_candidate_domains", "SELECT DISTINCT id, unnest([s || '.example', s || '-' || c || '.example', replace(s, '-', '') || '.example']) AS domain FROM (SELECT id, regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, regexp_replace(regexp_replace(strip_accents(lower(city)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS c FROM places WHERE name IS NOT NULL AND city IS NOT NULL)")
def x37(spark, d):
    p = table(spark, d, "places").where("name IS NOT NULL AND city IS NOT NULL").select("id", text.slug(C("name")).alias("s"), text.slug(C("city")).alias("c"))
    dot = F.lit(".example")
    return p.select("id", F.explode(F.array_distinct(F.array(F.concat("s", dot), F.concat("s", F.lit("-"), "c", dot), F.concat(F.replace("s", F.lit("-"), F.lit("")), dot)))).alias("domain")).distinct()
