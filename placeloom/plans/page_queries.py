"""Live sources, web pages, opening hours and the sorted extract: documents are built from the tables, read back by the engine
and checked against SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placeloom.functions import hours, html
from placeloom.plans.scalar_queries import _CODES
from placeloom.plans.venue_queries import P10
from placeloom.session import broadcast_if_small, shared_dir, table
from placeloom.sources import adapters, gazetteers, places

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


def payloads(df, record, wrap=lambda c: c, size: int = 100):
    """JSON documents of at most some ``size`` records each, as a source would answer."""
    return df.groupBy(F.floor(F.abs(C("id").cast("long")) / size).alias("page")).agg(F.to_json(wrap(F.collect_list(record))).alias("data"))


def numbered(spark, d):
    return table(spark, d, "live_venues").distinct()


_LIVE = "(SELECT DISTINCT * FROM live_venues)"


@query("s06_directory", f"SELECT 'bizdata' AS source, name, address, city, state, postal_code, phone, lat, lng FROM {_LIVE}")
def s06(spark, d):
    r = F.struct("name", "address", "city", "state", C("postal_code").alias("zip"), "phone", C("lat").cast("string").alias("latitude"), C("lng").cast("string").alias("longitude"))
    docs = payloads(numbered(spark, d), r, lambda c: F.struct(c.alias("results")))
    return adapters.directory(docs, "data").select("source", "name", "address", "city", "state", "postal_code", "phone", "lat", "lng")


@query("s07_map_elements", f"SELECT 'overpass' AS source, name, CASE WHEN address <> '' THEN address END AS address, city, phone, lat, lng FROM {_LIVE}")
def s07(spark, d):
    # even rows are nodes, odd ones ways that carry a center
    even = C("id") % 2 == 0
    tags = F.map_filter(F.create_map(F.lit("name"), C("name"), F.lit("addr:street"), C("address"), F.lit("addr:city"), C("city"), F.lit("contact:phone"), C("phone")), lambda _, v: v.isNotNull())
    r = F.struct(F.when(even, C("lat")).alias("lat"), F.when(even, C("lng")).alias("lon"), F.when(~even, F.struct("lat", C("lng").alias("lon"))).alias("center"), tags.alias("tags"))
    docs = payloads(numbered(spark, d), r, lambda c: F.struct(c.alias("elements")))
    return adapters.map_elements(docs, "data").select("source", "name", "address", "city", "phone", "lat", "lng")


@query("s08_map_search", "SELECT 'serpapi' AS source, name, phone, coalesce(array_to_string(list_sort(list_distinct(place_types)), ','), '') AS kinds, CAST(latitude AS DOUBLE) AS lat FROM restaurants")
def s08(spark, d):
    # the three spellings of a record's kinds
    k = C("id") % 3
    r = F.struct(C("name").alias("title"), "phone", F.struct(C("latitude").cast("double").alias("latitude"), C("longitude").cast("double").alias("longitude")).alias("gps_coordinates"),
                 F.when((k == 0) & (F.size("place_types") > 0), C("place_types")[0]).alias("type"), F.when(k < 2, C("place_types")).alias("types"), F.when(k == 2, C("place_types")).alias("type_ids"))
    docs = payloads(table(spark, d, "restaurants"), r, lambda c: F.struct(c.alias("local_results")))
    return adapters.map_search(docs, "data").select("source", "name", "phone", F.array_join(F.array_sort(F.array_distinct("place_types")), ",").alias("kinds"), "lat")


@query("s09_open_data", f"SELECT 'socrata' AS source, CASE WHEN name <> '' THEN name END AS name, CASE WHEN address <> '' THEN address END AS address, CASE WHEN postal_code <> '' THEN postal_code END AS postal_code, lat, lng FROM {_LIVE}")
def s09(spark, d):
    # aliases by turns: dba or business_name, coordinates beside or below location
    even = C("id") % 2 == 0
    r = F.struct(F.when(even, C("name")).alias("dba"), F.when(~even, C("name")).alias("business_name"), F.when(even, C("address")).alias("address"), F.when(~even, C("address")).alias("street_address"), C("postal_code").alias("zip_code"), "city",
                 F.when(even, C("lat").cast("string")).alias("latitude"), F.when(even, C("lng").cast("string")).alias("longitude"), F.when(~even, F.struct(C("lat").cast("string").alias("latitude"), C("lng").cast("string").alias("longitude"))).alias("location"))
    return adapters.open_data(payloads(numbered(spark, d), r), "data").select("source", "name", "address", "postal_code", "lat", "lng")


@query("s10_geojson", f"SELECT 'photon' AS source, name, city, lat, lng FROM {_LIVE} WHERE lat IS NOT NULL AND lng IS NOT NULL")
def s10(spark, d):
    v = numbered(spark, d).where("lat IS NOT NULL AND lng IS NOT NULL")
    r = F.struct(F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.map_filter(F.create_map(F.lit("name"), C("name"), F.lit("city"), C("city")), lambda _, x: x.isNotNull()).alias("properties"))
    return adapters.geojson(payloads(v, r, lambda c: F.struct(c.alias("features"))), "data").select("source", "name", "city", "lat", "lng")


@query("s11_knowledge_base", "SELECT 'wikidata' AS source, name, CAST(round(latitude, 5) AS DOUBLE) AS lat, CAST(round(longitude, 5) AS DOUBLE) AS lng FROM restaurants WHERE has_award AND latitude IS NOT NULL AND longitude IS NOT NULL")
def s11(spark, d):
    v = table(spark, d, "restaurants").where("has_award AND latitude IS NOT NULL AND longitude IS NOT NULL")
    point = F.concat(F.lit("Point("), F.round("longitude", 5).cast("string"), F.lit(" "), F.round("latitude", 5).cast("string"), F.lit(")"))
    r = F.struct(F.struct(C("name").alias("value")).alias("label"), F.struct(point.alias("value")).alias("coord"))
    docs = payloads(v, r, lambda c: F.struct(F.struct(c.alias("bindings")).alias("results")))
    return adapters.knowledge_base(docs, "data").select("source", "name", "lat", "lng")


@query("s07_source_requests", f"""
WITH z AS (SELECT zip, lat, lng, radius_km FROM zip_centroids WHERE radius_km IS NOT NULL)
SELECT zip, '[out:json];nwr["amenity"="restaurant"](around:' || CAST(CAST(round(radius_km * 1000) AS BIGINT) AS VARCHAR) || ',' || printf('%.6f', lat) || ',' || printf('%.6f', lng) || ');out center;' AS overpass,
  'within_circle(location, ' || printf('%.6f', lat) || ', ' || printf('%.6f', lng) || ', ' || CAST(CAST(round(radius_km * 1000) AS BIGINT) AS VARCHAR) || ')' AS soda,
  printf('%.4f', lng - radius_km / 111.32 / cos(radians(lat))) || ',' || printf('%.4f', lat - radius_km / 111.32) || ',' || printf('%.4f', lng + radius_km / 111.32 / cos(radians(lat))) || ',' || printf('%.4f', lat + radius_km / 111.32) AS bbox FROM z""")
def s07q(spark, d):
    z = table(spark, d, "zip_centroids").where("radius_km IS NOT NULL")
    return z.select("zip", adapters.overpass_request(C("lat"), C("lng"), C("radius_km")).alias("overpass"), adapters.soda_circle(C("lat"), C("lng"), C("radius_km")).alias("soda"), adapters.box_of(C("lat"), C("lng"), C("radius_km")).alias("bbox"))


def pages(spark, d):
    """A web page for each active venue, with linked data, a title and a text."""
    r = table(spark, d, "restaurants").where("is_active AND name IS NOT NULL AND slug IS NOT NULL")
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(C(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ld = F.to_json(F.struct(F.array(F.struct("name", C("phone").alias("telephone"), F.array(F.concat(F.lit("https://www.instagram.com/"), "slug", F.lit("/?hl=en"))).alias("sameAs"), F.array(F.struct(F.array(F.lit("https://schema.org/Monday"), F.lit("Tuesday")).alias("dayOfWeek"), F.lit("09:00:00").alias("opens"), F.lit("17:30").alias("closes"))).alias("openingHoursSpecification"))).alias("@graph")))
    page = F.concat(F.lit("<html><head><title> "), safe("name"), F.lit('</title><script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit('</script></head><body><p onclick="x()">Find us in '), safe("city"), F.lit(". <b>gone</b></p><script>var x = 1;</script></body></html>"))
    return r.select("id", "name", "phone", "city", "slug", page.alias("page"))


_NAMED = r"trim(regexp_replace(name, '\s+', ' ', 'g'), ' ')"


@query("s18_page_evidence", f"SELECT id, {_NAMED} AS title, {P10} AS phone, 'https://instagram.com/' || slug AS profile FROM restaurants WHERE is_active AND name IS NOT NULL AND slug IS NOT NULL")
def s18(spark, d):
    e = pages(spark, d).select("id", html.page_evidence(C("page")).alias("e"))
    return e.select("id", "e.title", F.try_element_at("e.phones", F.lit(1)).alias("phone"), F.try_element_at("e.profiles", F.lit(1)).alias("profile"))


@query("x29_page_hours", "SELECT id, day, '09:00' AS open, '17:30' AS close FROM restaurants CROSS JOIN (VALUES ('Monday'), ('Tuesday')) v(day) WHERE is_active AND name IS NOT NULL AND slug IS NOT NULL")
def x29(spark, d):
    return pages(spark, d).select("id", F.explode(html.page_hours(C("page"))["hours"]).alias("h")).select("id", "h.*")


@query("x20_sanitized", "SELECT id, '<p>Find us in ' || replace(replace(replace(coalesce(city, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '. </p>' AS body FROM restaurants WHERE is_active AND name IS NOT NULL AND slug IS NOT NULL")
def x20(spark, d):
    body = F.regexp_extract("page", r"(?s)<body>(.*)</body>", 1)
    return pages(spark, d).select("id", html.sanitized_html(body).alias("body"))


@query("m13_page_verdicts", f"""
WITH r AS (SELECT id, length(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) > 2 AS named, {P10} IS NOT NULL AS called FROM restaurants WHERE is_active AND name IS NOT NULL AND slug IS NOT NULL)
SELECT id, CASE WHEN called THEN 'verified' WHEN named THEN 'brand' ELSE 'unconfirmed' END AS verdict FROM r""")
def m13(spark, d):
    p = pages(spark, d).withColumn("e", html.page_evidence(C("page")))
    return p.select("id", html.verdict(C("e"), C("name"), C("phone"), C("city"), F.lit("no number")).alias("verdict"))


_SOCIAL = """
u AS (SELECT id, replace(unnest(coalesce(socials, [])), 'social.example', CASE length(id) % 2 + ascii(right(id, 1)) % 3 WHEN 0 THEN 'm.facebook.com' WHEN 1 THEN 'www.instagram.com' WHEN 2 THEN 'twitter.com/share' ELSE 'other.example' END) || '?hl=en' AS u FROM places),
p AS (SELECT id, u, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1, 'i')), '^(www|m|mobile)\\.', '') AS h, regexp_extract(u, '^https?://[^/?#]+/+([^/?#]+)', 1, 'i') AS f FROM u)
"""


def social_urls(spark, d):
    """Links of places on hosts of several sorts, some of them share links."""
    k = F.length("id") % 2 + F.ascii(F.right("id", F.lit(1))) % 3
    host = F.when(k == 0, "m.facebook.com").when(k == 1, "www.instagram.com").when(k == 2, "twitter.com/share").otherwise("other.example")
    u = table(spark, d, "places").select("id", F.explode("socials").alias("u"), host.alias("host"))
    return u.select("id", F.concat(F.replace("u", F.lit("social.example"), C("host")), F.lit("?hl=en")).alias("u"))


@query("x35_profiles", f"WITH {_SOCIAL} SELECT DISTINCT id, 'https://' || h || '/' || f AS profile FROM p WHERE h IN ('facebook.com', 'instagram.com')")
def x35(spark, d):
    return social_urls(spark, d).groupBy("id").agg(F.collect_set("u").alias("us")).select("id", F.explode(html.profiles_of(C("us"))).alias("profile"))


@query("d02_junk_socials", f"WITH {_SOCIAL} SELECT DISTINCT id, 'socials' AS field, 'no profile' AS reason, u AS detail FROM p WHERE h NOT IN ('facebook.com', 'instagram.com')")
def d02(spark, d):
    from placeloom.operators import quality

    u = social_urls(spark, d)
    return quality.findings(u.where(F.size(html.profiles_of(F.array("u"))) == 0), "socials", "no profile", C("u")).distinct()


@query("y07_linked_objects", "SELECT id, name FROM restaurants WHERE is_active AND name IS NOT NULL AND slug IS NOT NULL")
def y07(spark, d):
    """Names in a page's linked data, which stands below @graph."""
    return pages(spark, d).select("id", F.explode(html.page_evidence(C("page"))["names"]).alias("name"))


@query("x36_robots", "SELECT slug, NOT (starts_with(slug, 'a') OR contains(slug, 'sushi')) OR slug = 'american' AS allowed FROM cuisines")
def x36(spark, d):
    rules = F.lit("User-agent: *\nDisallow: /menu/a\nDisallow: /*sushi\nAllow: /menu/american$\n")
    return table(spark, d, "cuisines").select("slug", html.robots_allowed(rules, F.concat(F.lit("/menu/"), "slug")).alias("allowed"))


@query("x17_opening_hours", "SELECT id, CAST(day AS INTEGER) AS day, CAST(60 * (9 + id % 3) AS INTEGER) AS open, CAST(60 * (24 + id % 3) AS INTEGER) AS close FROM restaurants CROSS JOIN (VALUES (4), (5), (6), (0)) v(day) WHERE id % 4 > 0 OR day <> 6")
def x17(spark, d):
    # Friday to Monday over the week's end, closing after midnight; a later rule closes some on Sundays
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    t = F.concat(F.lit("Fr-Mo "), two(9 + C("id") % 3), F.lit(":00-"), two(C("id") % 3), F.lit(":00"), F.when(C("id") % 4 == 0, "; Su off").otherwise(""))
    return table(spark, d, "restaurants").select("id", F.explode(hours.hours(t)).alias("h")).select("id", "h.*")


@query("x30_listed_hours", "SELECT id, v.day, CASE v.day WHEN 'Monday' THEN CAST(1 + id % 9 AS VARCHAR) || ' PM' ELSE '11 AM' END AS open, '9 PM' AS close FROM restaurants CROSS JOIN (VALUES ('Monday'), ('Tuesday')) v(day) WHERE v.day = 'Monday' OR id % 2 = 0")
def x30(spark, d):
    n = (1 + C("id") % 9).cast("string")
    m = F.create_map(F.lit(" monday"), F.concat(n, F.lit("–9 PM")), F.lit("TUESDAY"), F.when(C("id") % 2 == 0, "11 AM - 9 PM").otherwise("11 AM-1 PM, 3-8 PM"), F.lit("wednesday"), F.lit("Closed"), F.lit("someday"), F.lit("1-2 PM"))
    return table(spark, d, "restaurants").select("id", F.explode(hours.listed_hours(m)).alias("h")).select("id", "h.*")


@query("k01_extract_box", "SELECT id, city, category FROM places WHERE lat BETWEEN 35 AND 42 AND lng BETWEEN -110 AND -80")
def k01(spark, d):
    # written sorted by position, then read with the box pushed to the row groups
    path = f"{shared_dir(spark).rstrip('/')}/extract-{uuid.uuid4().hex}"
    places.write_extract(table(spark, d, "places"), path)
    return places.read_box(spark, path, 35.0, 42.0, -110.0, -80.0).select("id", "city", "category")


@query("s15_state_names", f"SELECT upper(trim(region, ' ')) AS code, count(*) AS n FROM places WHERE upper(trim(region, ' ')) IN ({_CODES}) GROUP BY 1")
def s15(spark, d):
    g = broadcast_if_small(gazetteers.states(spark))
    p = table(spark, d, "places").select(F.upper(F.trim("region")).alias("code"))
    return p.join(g, "code").groupBy("code").agg(F.count("*").alias("n"))


@query("s02_partitioned_scan", "SELECT region, count(*) AS n, count(category) AS typed FROM places WHERE region IN ('UT', 'GA', 'TX') GROUP BY 1")
def s02(spark, d):
    # written by region, read with the other regions' folders left out
    path = f"{shared_dir(spark).rstrip('/')}/by-region-{uuid.uuid4().hex}"
    table(spark, d, "places").select("id", "category", "region").write.partitionBy("region").parquet(path)
    return spark.read.parquet(path).where("region IN ('UT', 'GA', 'TX')").groupBy("region").agg(F.count("*").alias("n"), F.count("category").alias("typed"))


@query("s14_json_lines", "SELECT event_type AS command, CAST(ts AS DATE) AS day, count(*) AS fires, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def s14(spark, d):
    # a log of JSON lines with one folder for each day; days outside the window are not opened, broken lines are skipped
    path = f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    lines = e.select("day", F.explode(F.array(F.to_json(F.struct(C("event_type").alias("command"), "event_id")), F.lit("{broken"))).alias("value"))
    lines.write.partitionBy("day").text(path)
    log = spark.read.schema("command string, event_id long, day date").option("mode", "DROPMALFORMED").json(path)
    return log.where("day >= DATE'2024-01-10' AND day < DATE'2024-01-15' AND command IS NOT NULL").groupBy("command", "day").agg(F.count("*").alias("fires"), F.max("event_id").alias("last_id"))


@query("k10_written_files", "SELECT CAST(floor((row_number() OVER (ORDER BY popularity_score DESC, id) - 1) / 500) AS BIGINT) AS file, '<url><loc>/venues/' || slug || '</loc></url>' AS line FROM restaurants WHERE is_active AND slug IS NOT NULL")
def k10(spark, d):
    from placeloom.operators.relational import ranked

    r = ranked(table(spark, d, "restaurants").where("is_active AND slug IS NOT NULL").select("id", "slug", "popularity_score"), "position", C("popularity_score").desc(), C("id"))
    path = f"{shared_dir(spark).rstrip('/')}/urls-{uuid.uuid4().hex}"
    r.select(F.floor((C("position") - 1) / 500).alias("file"), F.concat(F.lit("<url><loc>/venues/"), "slug", F.lit("</loc></url>")).alias("value")).write.partitionBy("file").text(path)
    return spark.read.text(path).select(C("file").cast("long").alias("file"), C("value").alias("line"))
