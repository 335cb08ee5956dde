"""Scalar, array and text functions over whole tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.session import table

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


HAV = "power(sin(radians(lat - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(lat)) * power(sin(radians(lng + 100.0) / 2), 2)"


@query("x01_haversine", f"SELECT id, round(12742 * atan2(sqrt({HAV}), sqrt(1 - ({HAV}))), 6) AS km FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL")
def x01(spark, d):
    return table(spark, d, "places").where("lat IS NOT NULL AND lng IS NOT NULL").select("id", F.round(geo.haversine_km(F.lit(40.0), F.lit(-100.0), C("lat"), C("lng")), 6).alias("km"))


@query("x02_haversine_asin", f"SELECT id, round(12742 * asin(least(1.0, sqrt({HAV}))), 6) AS km FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL")
def x02(spark, d):
    return table(spark, d, "places").where("lat IS NOT NULL AND lng IS NOT NULL").select("id", F.round(geo.haversine_asin_km(F.lit(40.0), F.lit(-100.0), C("lat"), C("lng")), 6).alias("km"))


@query("x03_cosine_law", "SELECT id, round(6371 * acos(greatest(-1.0, least(1.0, cos(radians(40.0)) * cos(radians(lat)) * cos(radians(lng) - radians(-100.0)) + sin(radians(40.0)) * sin(radians(lat))))), 6) AS km FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL")
def x03(spark, d):
    return table(spark, d, "places").where("lat IS NOT NULL AND lng IS NOT NULL").select("id", F.round(geo.cosine_law_km(F.lit(40.0), F.lit(-100.0), C("lat"), C("lng")), 6).alias("km"))


@query("x05_phone_key", "SELECT id, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS phone_key FROM restaurants")
def x05(spark, d):
    return table(spark, d, "restaurants").select("id", text.last_ten_digits(C("phone")).alias("phone_key"))


@query("x06_area_code", "SELECT substr(p, 1, 3) AS area_code, count(*) AS n, count(DISTINCT state) AS states FROM (SELECT state, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS p FROM restaurants) WHERE p IS NOT NULL GROUP BY 1")
def x06(spark, d):
    r = table(spark, d, "restaurants").select("state", text.last_ten_digits(C("phone")).alias("p")).where("p IS NOT NULL")
    return r.groupBy(F.left("p", F.lit(3)).alias("area_code")).agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"))


# written out for the SQL side, apart from the engine's own table
STATE_ROWS = """AL alabama,AK alaska,AZ arizona,AR arkansas,CA california,CO colorado,CT connecticut,DE delaware,DC district of columbia,FL florida,GA georgia,GU guam,HI hawaii,ID idaho,IL illinois,IN indiana,IA iowa,KS kansas,KY kentucky,LA louisiana,ME maine,MD maryland,MA massachusetts,
MI michigan,MN minnesota,MS mississippi,MO missouri,MT montana,NE nebraska,NV nevada,NH new hampshire,NJ new jersey,NM new mexico,NY new york,NC north carolina,ND north dakota,OH ohio,OK oklahoma,OR oregon,PA pennsylvania,RI rhode island,SC south carolina,SD south dakota,TN tennessee,TX texas,UT utah,VT vermont,VA virginia,
WA washington,WV west virginia,WI wisconsin,WY wyoming"""
_ROWS = [x.strip().split(" ", 1) for x in STATE_ROWS.replace("\n", "").split(",")]
_CASE = " ".join(f"WHEN lower(trim(state)) = '{n}' THEN '{c}'" for c, n in _ROWS)
_CODES = ", ".join(f"'{c}'" for c, _ in _ROWS)


@query("x07_state_code", f"SELECT id, CASE WHEN upper(trim(state)) IN ({_CODES}) THEN upper(trim(state)) {_CASE} END AS state_code FROM restaurants")
def x07(spark, d):
    return table(spark, d, "restaurants").select("id", text.state_code(C("state")).alias("state_code"))


@query("x07_all_states", f"SELECT code, length(code) AS n, code AS again FROM (SELECT DISTINCT unnest([{_CODES}]) AS code)")
def x07all(spark, d):
    """Every code from its name and from itself."""
    names = spark.createDataFrame([(k.title(),) for k in text.STATES], "name string")
    code = text.state_code(C("name"))
    return names.select(code.alias("code"), F.length(code).cast("long").alias("n"), text.state_code(F.lower(code)).alias("again"))


ADDRESS_SQL = r"""
ad_a AS (SELECT id, postal_code, list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS p0 FROM restaurants),
ad_b AS (SELECT *, CASE WHEN upper(replace(p0[-1], '.', '')) IN ('US', 'USA', 'UNITED STATES') THEN p0[:-2] ELSE p0 END AS p1 FROM ad_a),
ad_c AS (SELECT *, CASE WHEN len(p1) > 0 AND regexp_matches(p1[-1], '\s(US|USA)\.?$', 'i') THEN list_concat(p1[:-2], [regexp_replace(p1[-1], '\s+(US|USA)\.?$', '', 'i')]) ELSE p1 END AS p FROM ad_b),
w AS (SELECT id, postal_code, p, len(p) AS n, CASE WHEN len(p) > 0 THEN regexp_split_to_array(p[-1], '\s+') ELSE [] END AS w FROM ad_c)
"""


@query("x08_zip_of_address", f"""
WITH {ADDRESS_SQL}
SELECT id, CASE WHEN regexp_matches(w[-1], '^\\d{{5}}(-\\d{{4}})?$') AND NOT (n = 2 AND len(w) = 1 AND NOT regexp_matches(p[1], '^\\d')) THEN left(w[-1], 5)
  WHEN regexp_matches(trim(postal_code, ' '), '^\\d{{5}}(-\\d{{4}})?$') THEN left(trim(postal_code, ' '), 5) END AS zip FROM w""")
def x08(spark, d):
    return table(spark, d, "restaurants").select("id", text.zip_of(C("address"), C("postal_code")).alias("zip"))


@query("x09_city_of_address", f"""
WITH {ADDRESS_SQL},
q AS (SELECT *, coalesce(regexp_matches(w[1], '^[A-Z][A-Z]$'), false) AS two FROM w),
r AS (SELECT *, two AND ((len(w) = 2 AND regexp_matches(w[2], '^\\d{{5}}(-\\d{{4}})?$') AND n >= 2) OR (len(w) = 1 AND n >= 3 AND w[1] IN ({_CODES}))) AS by_state, len(w) = 1 AND n >= 3 AND regexp_matches(w[1], '^\\d{{5}}(-\\d{{4}})?$') AS by_zip, n = 3 AND regexp_matches(p[2], '^\\d+$') AS by_number FROM q),
s AS (SELECT *, CASE WHEN by_state OR by_zip THEN p[-2] WHEN by_number THEN p[-1] END AS city FROM r)
SELECT id, CASE WHEN regexp_matches(city, '^[A-Za-z][A-Za-z .''-]+$') THEN city END AS city, CASE WHEN regexp_matches(city, '^[A-Za-z][A-Za-z .''-]+$') AND by_state AND w[1] IN ({_CODES}) THEN w[1] END AS state FROM s""")
def x09(spark, d):
    return table(spark, d, "restaurants").select("id", text.city_state_of(C("address")).alias("c")).select("id", "c.city", "c.state")


@query("x18_title_cased", r"SELECT DISTINCT city, CASE WHEN trim(coalesce(city, ''), ' ') <> '' THEN array_to_string(list_transform(string_split(lower(trim(regexp_replace(city, '\s+', ' ', 'g'), ' ')), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('of', 'the', 'and', 'at', 'in', 'on', 'de', 'la', 'del') THEN w ELSE upper(w[1]) || w[2:] END), ' ') END AS title FROM restaurants")
def x18t(spark, d):
    return table(spark, d, "restaurants").select("city").distinct().select("city", text.title_case(C("city")).alias("title"))


@query("x10_place_key", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(name)), '\bsaint\b', 'st', 'g'), '\bmount\b', 'mt', 'g'), '\bfort\b', 'ft', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') AS place_key FROM restaurants")
def x10(spark, d):
    return table(spark, d, "restaurants").select("id", text.place_key(C("name")).alias("place_key"))


@query("x14_miles", "SELECT zip, round(radius_km * 0.621371, 2) AS miles FROM zip_centroids")
def x14(spark, d):
    return table(spark, d, "zip_centroids").select("zip", F.round(C("radius_km") * geo.MILES_PER_KM, 2).alias("miles"))


@query("x15_grid_cells", "SELECT CAST(floor(lat / 0.5) AS BIGINT) AS cell_y, CAST(floor(lng / 0.5) AS BIGINT) AS cell_x, count(*) AS n, count(DISTINCT user_id) AS users FROM geolocation_fixes WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 GROUP BY 1, 2")
def x15(spark, d):
    y, x = geo.cell(C("lat"), C("lng"), 0.5)
    return table(spark, d, "geolocation_fixes").where("lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180").groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("x16_slug", "SELECT id, regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(md5(id), 1, 6) AS slug FROM places WHERE name IS NOT NULL")
def x16(spark, d):
    return table(spark, d, "places").where("name IS NOT NULL").select("id", F.concat(text.slug(C("name")), F.lit("-"), F.substring(F.md5("id"), 1, 6)).alias("slug"))


@query("x18_collapsed", r"SELECT id, trim(regexp_replace(name, '\s+', ' ', 'g'), ' ') AS name, trim(regexp_replace(address, '\s+', ' ', 'g'), ' ') AS address FROM restaurants")
def x18(spark, d):
    return table(spark, d, "restaurants").select("id", text.collapsed(C("name")).alias("name"), text.collapsed(C("address")).alias("address"))


@query("x22_url_host", r"SELECT regexp_replace(lower(regexp_extract(website_url, '^https?://([^/?#:]+)', 1, 'i')), '^www\.', '') AS host, count(*) AS n FROM restaurants WHERE website_url IS NOT NULL GROUP BY 1")
def x22(spark, d):
    return table(spark, d, "restaurants").where("website_url IS NOT NULL").groupBy(text.url_host(C("website_url")).alias("host")).agg(F.count("*").alias("n"))


@query("x23_days_since", "SELECT id, round((epoch_us(TIMESTAMP '2026-06-30 00:00:00') - epoch_us(updated_at)) / 86400e6, 6) AS days FROM restaurants")
def x23(spark, d):
    return table(spark, d, "restaurants").select("id", F.round((F.unix_micros(F.lit("2026-06-30").cast("timestamp")) - F.unix_micros(C("updated_at").cast("timestamp"))) / F.lit(86400e6), 6).alias("days"))


@query("x24_clamped", "SELECT fix_id, received_at, greatest(-90.0, least(90.0, lat)) AS lat, greatest(-180.0, least(180.0, lng)) AS lng, round(greatest(0.0, least(1.0, accuracy_m / 1000)), 6) AS share FROM geolocation_fixes WHERE NOT isnan(coalesce(lat, 0)) AND NOT isnan(coalesce(lng, 0)) AND NOT isnan(coalesce(accuracy_m, 0)) AND lat IS NOT NULL AND lng IS NOT NULL AND accuracy_m IS NOT NULL")
def x24(spark, d):
    f = table(spark, d, "geolocation_fixes").where("NOT isnan(coalesce(lat, 0)) AND NOT isnan(coalesce(lng, 0)) AND NOT isnan(coalesce(accuracy_m, 0)) AND lat IS NOT NULL AND lng IS NOT NULL AND accuracy_m IS NOT NULL")
    lim = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    return f.select("fix_id", "received_at", lim(C("lat"), -90.0, 90.0).alias("lat"), lim(C("lng"), -180.0, 180.0).alias("lng"), F.round(lim(C("accuracy_m") / 1000, 0.0, 1.0), 6).alias("share"))


@query("x27_boxes", "SELECT zip, round(radius_km * 1.1 / 111.0, 6) AS d_lat, round(radius_km * 1.1 / 111.0 / cos(radians(greatest(-89.9, least(89.9, lat)))), 6) AS d_lng FROM zip_centroids")
def x27(spark, d):
    d_lat = C("radius_km") * 1.1 / geo.KM_PER_DEGREE
    return table(spark, d, "zip_centroids").select("zip", F.round(d_lat, 6).alias("d_lat"), F.round(d_lat / F.cos(F.radians(F.greatest(F.lit(-89.9), F.least(F.lit(89.9), C("lat"))))), 6).alias("d_lng"))


@query("x28_formatted", "SELECT id, format('{:,}', google_review_count) || ' reviews' AS label FROM restaurants")
def x28(spark, d):
    return table(spark, d, "restaurants").select("id", F.concat(F.format_number("google_review_count", 0), F.lit(" reviews")).alias("label"))


@query("x33_name_keys", "SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' ') AS ascii_key, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g'), ' ') AS folded_key FROM places")
def x33(spark, d):
    return table(spark, d, "places").select("id", text.name_key(C("name")).alias("ascii_key"), F.trim(F.regexp_replace(text.folded(C("name")), "[^a-z0-9]+", " ")).alias("folded_key"))


@query("x38_coalesced_coordinates", "SELECT r.id, coalesce(CASE WHEN r.latitude <> 0 AND r.longitude <> 0 THEN CAST(r.latitude AS DOUBLE) END, z.lat) AS lat, coalesce(CASE WHEN r.latitude <> 0 AND r.longitude <> 0 THEN CAST(r.longitude AS DOUBLE) END, z.lng) AS lng FROM restaurants r LEFT JOIN zip_centroids z ON substr(r.postal_code, 1, 5) = z.zip")
def x38(spark, d):
    r, z = table(spark, d, "restaurants"), table(spark, d, "zip_centroids").select(C("zip").alias("_z"), C("lat").alias("z_lat"), C("lng").alias("z_lng"))
    j = r.join(z, F.substring("postal_code", 1, 5) == C("_z"), "left")
    ok = geo.known(C("latitude"), C("longitude"))
    return j.select("id", F.coalesce(F.when(ok, C("latitude").cast("double")), C("z_lat")).alias("lat"), F.coalesce(F.when(ok, C("longitude").cast("double")), C("z_lng")).alias("lng"))


@query("y01_json_path", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(json_array_length(json_array(props, event_type))) AS width FROM events GROUP BY 1")
def y01(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.max(F.json_array_length(F.to_json(F.array("props", "event_type")))).cast("long").alias("width"))


@query("y03_json_shape", """SELECT id, list_count(list_distinct(list_concat(coalesce(websites, []), coalesce(socials, [])))) AS urls, json_array_length(to_json(coalesce(datasets, []))) AS sources FROM places""")
def y03(spark, d):
    none = F.array().cast("array<string>")
    return table(spark, d, "places").select("id", F.size(F.array_compact(F.array_distinct(F.concat(F.coalesce("websites", none), F.coalesce("socials", none))))).cast("long").alias("urls"), F.json_array_length(F.to_json(F.coalesce("datasets", none))).cast("long").alias("sources"))


@query("y05_first_elements", "SELECT id, websites[1] AS website, phones[1] AS phone, datasets[-1] AS last_dataset FROM places")
def y05(spark, d):
    return table(spark, d, "places").select("id", F.try_element_at("websites", F.lit(1)).alias("website"), F.try_element_at("phones", F.lit(1)).alias("phone"), F.try_element_at("datasets", F.lit(-1)).alias("last_dataset"))


@query("y06_provenance_merge", """SELECT id, CASE WHEN trim(coalesce(phone, '')) = '' THEN 'directory' ELSE coalesce(element_at(field_sources, 'phone')[1], 'own') END AS phone_source, CASE WHEN field_sources IS NULL THEN 1 ELSE cardinality(field_sources) + CASE WHEN len(element_at(field_sources, 'website_url')) = 0 OR element_at(field_sources, 'website_url')[1] IS NULL THEN 1 ELSE 0 END END AS tags FROM restaurants""")
def y06(spark, d):
    r = table(spark, d, "restaurants")
    own = F.coalesce("field_sources", F.create_map().cast("map<string,string>"))
    extra = F.map_filter(F.create_map(F.lit("website_url"), F.lit("directory")), lambda k, _: ~F.array_contains(F.map_keys(own), k))
    src = F.when(text.blank(C("phone")), "directory").otherwise(F.coalesce(F.try_element_at("field_sources", F.lit("phone")), F.lit("own")))
    return r.select("id", src.alias("phone_source"), F.size(F.map_concat(own, extra)).cast("long").alias("tags"))


@query("y08_split_tags", "SELECT t AS tag, count(*) AS n FROM (SELECT unnest(string_split(category, '_')) AS t FROM places WHERE category IS NOT NULL) GROUP BY 1")
def y08(spark, d):
    return table(spark, d, "places").select(F.explode(F.split("category", "_")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("u02_ordered_union", """
WITH s AS (SELECT a.id, list_concat(coalesce(a.websites, []), coalesce(a.socials, [])) AS l FROM places a)
SELECT id, array_to_string(list_slice(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN i END), lambda i: i IS NOT NULL), lambda i: l[i]), 1, 6), ' ') AS urls FROM s""")
def u02(spark, d):
    none = F.array().cast("array<string>")
    urls = F.slice(F.array_distinct(F.array_compact(F.concat(F.coalesce("websites", none), F.coalesce("socials", none)))), 1, 6)
    return table(spark, d, "places").select("id", F.array_join(urls, " ").alias("urls"))


@query("u05_tag_diff", """SELECT id, array_to_string(list_sort(list_filter(coalesce(place_types, []), lambda t: t <> 'restaurant')), ',') AS added, list_contains(coalesce(place_types, []), 'restaurant') AS kept, len(list_filter(['restaurant', 'bar'], lambda t: NOT list_contains(coalesce(place_types, []), t))) AS dropped FROM restaurants""")
def u05(spark, d):
    t = F.coalesce("place_types", F.array().cast("array<string>"))
    base = F.array(F.lit("restaurant"), F.lit("bar"))
    return table(spark, d, "restaurants").select("id", F.array_join(F.array_sort(F.filter(t, lambda x: x != "restaurant")), ",").alias("added"), F.array_contains(t, "restaurant").alias("kept"), F.size(F.array_except(base, t)).cast("long").alias("dropped"))


@query("u06_superset", "SELECT datasets IS NOT NULL AND len(list_filter(['osm', 'meta'], lambda x: NOT list_contains(datasets, x))) = 0 AS covers, count(*) AS n FROM places GROUP BY 1")
def u06(spark, d):
    need = F.array(F.lit("osm"), F.lit("meta"))
    return table(spark, d, "places").groupBy(F.coalesce(F.size(F.array_except(need, "datasets")) == 0, F.lit(False)).alias("covers")).agg(F.count("*").alias("n"))


@query("u07_first_of_key", """SELECT fix_id, user_id, received_at FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY received_at, lat NULLS FIRST, lng NULLS FIRST) AS k FROM geolocation_fixes) WHERE k = 1""")
def u07(spark, d):
    f = table(spark, d, "geolocation_fixes")
    best = f.groupBy("fix_id").agg(F.min(F.struct("received_at", "lat", "lng", "user_id")).alias("b"))
    return best.select("fix_id", "b.user_id", "b.received_at")
