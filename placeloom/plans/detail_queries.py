"""Single signals, key forms and list unions of the inventory, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import quality, scoring
from placeloom.plans.relational_queries import FIELDS, has
from placeloom.plans.scalar_queries import _CODES, _ROWS, ADDRESS_SQL
from placeloom.plans.venue_queries import P10, _ST, km_sql
from placeloom.session import broadcast_if_small, table
from placeloom.streaming import engagement

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


@query("x11_glued_states", r"""
WITH c AS (SELECT DISTINCT lower(trim(city, ' ')) AS k FROM restaurants WHERE city IS NOT NULL),
g AS (SELECT k, regexp_extract(k, '^(.+?)\s+([a-z]{2})$', 1) AS base, upper(regexp_extract(k, '^(.+?)\s+([a-z]{2})$', 2)) AS st FROM c)
SELECT k AS city, CASE WHEN base <> '' AND st IN ('CODES') AND base IN (SELECT k FROM c) THEN base END AS place FROM g""".replace("CODES", "', '".join(sorted(set(text.STATES.values())))))
def x11(spark, d):
    c = table(spark, d, "restaurants").where("city IS NOT NULL").select(F.lower(F.trim("city")).alias("k")).distinct()
    p = r"^(.+?)\s+([a-z]{2})$"
    g = c.withColumn("base", F.regexp_extract("k", p, 1)).withColumn("st", F.upper(F.regexp_extract("k", p, 2)))
    j = g.join(c.select(C("k").alias("base"), F.lit(True).alias("known")), "base", "left")
    return j.select(C("k").alias("city"), F.when(C("known") & C("st").isin(sorted(set(text.STATES.values()))), C("base")).alias("place"))


@query("x19_cache_keys", "SELECT md5(concat_ws('|', source, coalesce(lower(trim(city, ' ')), ''), CAST(CAST(floor(lat * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(lng * 1000) AS BIGINT) AS VARCHAR))) AS key, count(*) AS n FROM live_venues GROUP BY 1")
def x19(spark, d):
    at = lambda c: F.floor(C(c) * 1000).cast("string")
    return table(spark, d, "live_venues").groupBy(F.md5(F.concat_ws("|", "source", F.coalesce(F.lower(F.trim("city")), F.lit("")), at("lat"), at("lng"))).alias("key")).agg(F.count("*").alias("n"))


@query("x21_word_boundaries", r"SELECT id, regexp_matches(address, '\b' || substr(postal_code, 1, 5) || '\b') AS zip_in_address FROM restaurants")
def x21(spark, d):
    return table(spark, d, "restaurants").select("id", F.rlike(C("address"), F.concat(F.lit(r"\b"), F.substring("postal_code", 1, 5), F.lit(r"\b"))).alias("zip_in_address"))


@query("j16_area_code_state", f"""
WITH r AS (SELECT id, {_ST} AS st, substr({P10}, 1, 3) AS area FROM restaurants),
h AS (SELECT area, st AS home FROM (SELECT area, st, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, st DESC) AS k FROM r WHERE area IS NOT NULL AND st IS NOT NULL GROUP BY area, st) WHERE k = 1)
SELECT r.id, h.home FROM r LEFT JOIN h USING (area)""")
def j16(spark, d):
    r = table(spark, d, "restaurants").select("id", text.state_code(C("state")).alias("st"), F.left(text.last_ten_digits(C("phone")), F.lit(3)).alias("area"))
    home = r.where("area IS NOT NULL AND st IS NOT NULL").groupBy("area", "st").count().groupBy("area").agg(F.max_by("st", F.struct("count", "st")).alias("home"))
    return r.join(home, "area", "left").select("id", "home")


@query("d08_postal_corrections", f"""
WITH r AS (SELECT id, substr(postal_code, 1, 5) AS z, regexp_extract(address, '(\\d{{5}})(-\\d{{4}})?$', 1) AS a, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng FROM restaurants WHERE latitude <> 0 AND longitude <> 0)
SELECT r.id, CASE WHEN {km_sql('z.lat', 'z.lng', 'r.lat', 'r.lng')} <= 50 THEN 'kept' WHEN {km_sql('w.lat', 'w.lng', 'r.lat', 'r.lng')} <= 50 THEN 'corrected' ELSE 'removed' END AS action FROM r JOIN zip_centroids z ON z.zip = r.z LEFT JOIN zip_centroids w ON w.zip = r.a""")
def d08(spark, d):
    z = table(spark, d, "zip_centroids")
    own = broadcast_if_small(z.select(C("zip").alias("z"), C("lat").alias("z_lat"), C("lng").alias("z_lng")))
    other = broadcast_if_small(z.select(C("zip").alias("a"), C("lat").alias("a_lat"), C("lng").alias("a_lng")))
    r = table(spark, d, "restaurants").where("latitude <> 0 AND longitude <> 0").select("id", F.substring("postal_code", 1, 5).alias("z"), F.regexp_extract("address", r"(\d{5})(-\d{4})?$", 1).alias("a"), C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    j = r.join(own, "z").join(other, "a", "left")
    near = lambda p: geo.haversine_asin_km(C(f"{p}_lat"), C(f"{p}_lng"), C("lat"), C("lng")) <= 50
    return j.select("id", F.when(near("z"), "kept").when(near("a"), "corrected").otherwise("removed").alias("action"))


@query("d10_noted_fields", "SELECT id, unnest(map_keys(field_sources)) AS field, 'noted source' AS reason FROM restaurants")
def d10(spark, d):
    return table(spark, d, "restaurants").select("id", F.explode(F.map_keys("field_sources")).alias("field")).withColumn("reason", F.lit("noted source"))


@query("o06_presence_sort", "SELECT id, row_number() OVER (ORDER BY (website_url IS NOT NULL AND website_url <> '') DESC, website_clicks_count DESC, id) AS position FROM restaurants")
def o06(spark, d):
    from placeloom.operators.relational import ranked

    r = table(spark, d, "restaurants").select("id", F.coalesce(has("website_url"), F.lit(False)).alias("site"), "website_clicks_count")
    return ranked(r, "position", C("site").desc(), C("website_clicks_count").desc(), C("id")).select("id", "position")


@query("u01_source_union", "SELECT source, count(*) AS n, count(DISTINCT city) AS cities FROM (SELECT 'restaurants' AS source, city FROM restaurants UNION ALL SELECT 'places', city FROM places UNION ALL SELECT 'live', city FROM live_venues) GROUP BY 1")
def u01(spark, d):
    part = lambda t, s: table(spark, d, t).select(F.lit(s).alias("source"), "city")
    return part("restaurants", "restaurants").unionByName(part("places", "places")).unionByName(part("live_venues", "live")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("city").alias("cities"))


@query("u03_type_union", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(datasets, []), CASE WHEN category IS NULL THEN [] ELSE [category] END))), ',') AS kinds FROM places")
def u03(spark, d):
    none = F.array().cast("array<string>")
    return table(spark, d, "places").select("id", F.array_join(F.array_sort(F.array_union(F.coalesce("datasets", none), F.array_compact(F.array("category")))), ",").alias("kinds"))


@query("u04_stable_first", "SELECT id, array_to_string(list_concat(list_filter(coalesce(websites, []), lambda u: starts_with(u, 'https')), list_filter(coalesce(socials, []), lambda u: starts_with(u, 'https')), list_filter(coalesce(websites, []), lambda u: NOT starts_with(u, 'https')), list_filter(coalesce(socials, []), lambda u: NOT starts_with(u, 'https'))), ' ') AS urls FROM places")
def u04(spark, d):
    none = F.array().cast("array<string>")
    w, s = F.coalesce("websites", none), F.coalesce("socials", none)
    part = lambda c, ok: F.filter(c, (lambda u: u.startswith("https")) if ok else (lambda u: ~u.startswith("https")))
    return table(spark, d, "places").select("id", F.array_join(F.concat(part(w, True), part(s, True), part(w, False), part(s, False)), " ").alias("urls"))


def joined(spark, d):
    r = table(spark, d, "restaurants")
    return r, r.crossJoin(F.broadcast(scoring.collection_stats(r)))


def signal(df, name):
    return next((a, v) for s, a, v in scoring.signals(df, scoring.ScoringConfig()) if s == name)


@query("r03_quality", """
WITH m AS (SELECT coalesce(avg(CAST(google_rating AS DOUBLE)) FILTER (WHERE google_rating > 0 AND google_review_count >= 50 AND latitude <> 0 AND longitude <> 0), 4.0) AS c FROM restaurants)
SELECT id, round(greatest(0.0, least(1.0, (google_review_count / (google_review_count + 50.0) * CAST(google_rating AS DOUBLE) + 50 / (google_review_count + 50.0) * c) / 5)), 6) AS quality FROM restaurants, m WHERE google_rating > 0""")
def r03(spark, d):
    _, j = joined(spark, d)
    a, v = signal(j, "quality")
    return j.where(a).select("id", F.round(v, 6).alias("quality"))


@query("r05_log_counts", "SELECT id, round(least(1.0, ln(1 + pageviews_count) / ln(1 + (SELECT coalesce(greatest(max(pageviews_count) FILTER (WHERE pageviews_count > 0), 500), 5000) FROM restaurants))), 6) AS views FROM restaurants")
def r05(spark, d):
    _, j = joined(spark, d)
    return j.select("id", F.round(signal(j, "pageviews_count")[1], 6).alias("views"))


@query("r06_inverse_distance", f"SELECT id, round(1 / (1 + {km_sql('43.0', '-114.1', 'CAST(latitude AS DOUBLE)', 'CAST(longitude AS DOUBLE)')} / 2.0), 6) AS proximity FROM restaurants WHERE latitude <> 0 AND longitude <> 0")
def r06(spark, d):
    _, j = joined(spark, d)
    j = j.where("latitude <> 0 AND longitude <> 0").withColumn("distance", geo.haversine_asin_km(F.lit(43.0), F.lit(-114.1), C("latitude").cast("double"), C("longitude").cast("double")))
    return j.select("id", F.round(signal(j, "proximity")[1], 6).alias("proximity"))


@query("r07_min_max", "WITH s AS (SELECT min(total_engagement) FILTER (WHERE total_engagement > 0) AS a, max(total_engagement) FILTER (WHERE total_engagement > 0) AS z FROM restaurants) SELECT id, round(CASE WHEN a IS NULL OR a = z THEN 0.5 ELSE greatest(0.0, least(1.0, (total_engagement - a) / CAST(z - a AS DOUBLE))) END, 6) AS share FROM restaurants, s")
def r07(spark, d):
    r = table(spark, d, "restaurants").select("id", "total_engagement")
    some = F.when(C("total_engagement") > 0, C("total_engagement"))
    s = F.broadcast(r.agg(F.min(some).alias("a"), F.max(some).alias("z")))
    share = scoring.clamp((C("total_engagement") - C("a")) / (C("z") - C("a")).cast("double"))
    return r.crossJoin(s).select("id", F.round(F.when(C("a").isNull() | (C("a") == C("z")), 0.5).otherwise(share), 6).alias("share"))


@query("r08_linear_rating", "SELECT id, round(greatest(0.0, least(1.0, CAST(yelp_rating AS DOUBLE) / 5)), 6) AS yelp FROM restaurants WHERE yelp_rating IS NOT NULL")
def r08(spark, d):
    return table(spark, d, "restaurants").where("yelp_rating IS NOT NULL").select("id", F.round(scoring.clamp(C("yelp_rating").cast("double") / 5), 6).alias("yelp"))


_FILLED = " + ".join([*(f"(CASE WHEN trim(coalesce({f}, ''), ' ') <> '' THEN 1 ELSE 0 END)" for f in ("name", "address", "phone", "price_range", "website_url", "photo_url")), "(CASE WHEN coalesce(latitude, 0) <> 0 THEN 1 ELSE 0 END)", "(CASE WHEN coalesce(longitude, 0) <> 0 THEN 1 ELSE 0 END)"])


@query("r09_completeness", f"SELECT id, round(({_FILLED}) / 10.0, 4) AS completeness FROM restaurants")
def r09(spark, d):
    _, j = joined(spark, d)
    return j.select("id", F.round(signal(j, "data_completeness")[1], 4).alias("completeness"))


@query("r10_evidence", "SELECT id, CAST(round(CAST(0.85 * (0.20 * greatest(0.0, least(1.0, coalesce(CAST(overture_confidence AS DOUBLE), 0.0))) + 0.20 * CASE WHEN trim(coalesce(website_url, ''), ' ') <> '' THEN 0.3 ELSE 0.0 END) AS DECIMAL(18, 12)), 4) AS DOUBLE) AS evidence FROM restaurants WHERE NOT coalesce(google_rating > 0, false)")
def r10(spark, d):
    _, j = joined(spark, d)
    a, v = signal(j, "evidence")
    return j.where(a).select("id", v.alias("evidence"))


@query("a13_denominators", "SELECT CAST(coalesce(greatest(max(website_clicks_count) FILTER (WHERE website_clicks_count > 0), 500), 5000) AS DOUBLE) AS den_website_clicks_count, CAST(5000 AS DOUBLE) AS den_menu_click_count FROM restaurants")
def a13(spark, d):
    return scoring.collection_stats(table(spark, d, "restaurants")).select("den_website_clicks_count", "den_menu_click_count")


@query("d13_field_gaps", "SELECT state, " + ", ".join(f"count(*) FILTER (WHERE {f} IS NULL OR trim({f}, ' ') = '') AS no_{f}" for f in FIELDS if f != "state") + " FROM restaurants GROUP BY 1")
def d13(spark, d):
    return table(spark, d, "restaurants").groupBy("state").agg(*[F.count_if(text.blank(C(f))).alias(f"no_{f}") for f in FIELDS if f != "state"])


@query("d13_tidied", f"""
WITH {ADDRESS_SQL},
q AS (SELECT id, p, n, w, coalesce(regexp_matches(w[1], '^[A-Z][A-Z]$'), false) AS two FROM w),
r AS (SELECT *, two AND ((len(w) = 2 AND regexp_matches(w[2], '^\\d{{5}}(-\\d{{4}})?$') AND n >= 2) OR (len(w) = 1 AND n >= 3 AND w[1] IN ({_CODES}))) AS by_state, len(w) = 1 AND n >= 3 AND regexp_matches(w[1], '^\\d{{5}}(-\\d{{4}})?$') AS by_zip, n = 3 AND regexp_matches(p[2], '^\\d+$') AS by_number FROM q),
s AS (SELECT *, CASE WHEN by_state OR by_zip THEN p[-2] WHEN by_number THEN p[-1] END AS c1 FROM r),
x AS (SELECT id, CASE WHEN regexp_matches(c1, '^[A-Za-z][A-Za-z .''-]+$') THEN c1 END AS a_city, CASE WHEN regexp_matches(c1, '^[A-Za-z][A-Za-z .''-]+$') AND by_state AND w[1] IN ({_CODES}) THEN w[1] END AS a_state FROM s),
y AS (SELECT t.id, t.name AS n0, t.address AS a0, t.city AS c0, t.state AS s0, t.phone AS p0, coalesce(nullif(trim(regexp_replace(name, '\\s+', ' ', 'g'), ' '), ''), name) AS name, nullif(trim(regexp_replace(address, '\\s+', ' ', 'g'), ' '), '') AS address,
  CASE WHEN trim(coalesce(city, ''), ' ') <> '' THEN city ELSE a_city END AS c2, CASE WHEN trim(coalesce(state, ''), ' ') <> '' THEN coalesce({_ST}, trim(state, ' ')) ELSE a_state END AS state, {P10} AS phone FROM restaurants t JOIN x ON x.id = t.id),
v AS (SELECT *, CASE WHEN trim(coalesce(c2, ''), ' ') <> '' THEN array_to_string(list_transform(string_split(lower(trim(regexp_replace(c2, '\\s+', ' ', 'g'), ' ')), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('of', 'the', 'and', 'at', 'in', 'on', 'de', 'la', 'del') THEN w ELSE upper(w[1]) || w[2:] END), ' ') END AS city FROM y)
SELECT id, name, address, city, state, phone, array_to_string(list_filter([CASE WHEN name IS DISTINCT FROM n0 THEN 'name' END, CASE WHEN address IS DISTINCT FROM a0 THEN 'address' END, CASE WHEN city IS DISTINCT FROM c0 THEN 'city' END, CASE WHEN state IS DISTINCT FROM s0 THEN 'state' END, CASE WHEN phone IS DISTINCT FROM p0 THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS changed FROM v""")
def d13t(spark, d):
    return quality.tidied(table(spark, d, "restaurants"))


@query("d12_problems", """
WITH g AS (SELECT * FROM (VALUES ('view', 60, 0, 30), ('click', 1440, 5, 30), ('signup', 30, 0, 2880), ('purchase', 2, 0, 30), ('refund', 1440, 0, 30)) v(command, every_minutes, offset_minutes, budget_minutes)),
f AS (SELECT event_type AS command, ts, CASE WHEN value > 50 THEN 'done' WHEN value > 1 THEN 'failed' END AS status, epoch_us(ts) / 60e6 AS m FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20'),
b AS (SELECT f.*, g.*, ((m - offset_minutes) % every_minutes + every_minutes) % every_minutes AS behind, epoch_us(TIMESTAMP '2024-01-20') / 60e6 AS z FROM f JOIN g USING (command)),
p AS (SELECT command, count(*) AS fires, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IS NULL AND z - m > budget_minutes) AS hung, arg_max(least(behind, every_minutes - behind), ts) AS last_drift, count(*) FILTER (WHERE least(behind, every_minutes - behind) > 10) AS off, max(m) AS last FROM b GROUP BY 1),
j AS (SELECT g.*, p.* EXCLUDE command, coalesce(fires, 0) AS n, floor((epoch_us(TIMESTAMP '2024-01-20') / 60e6 - offset_minutes) / every_minutes) - floor((epoch_us(TIMESTAMP '2024-01-08') / 60e6 - offset_minutes - 1e-9) / every_minutes) AS slots FROM g LEFT JOIN p USING (command))
SELECT command, n = 0 AND slots > 0 AS never_fired, coalesce(failed > 0, false) AS failed, coalesce(hung > 0, false) AS hung, coalesce(last_drift > 10, false) AS off_schedule, coalesce(off, 0) AS off_schedule_fires, coalesce(epoch_us(TIMESTAMP '2024-01-20') / 60e6 - last > 1.5 * every_minutes, false) AS stopped_firing, n > slots AS over_fired FROM j""")
def d12p(spark, d):
    e = table(spark, d, "events").select(C("event_type").alias("command"), C("ts").cast("timestamp").alias("at"), F.when(C("value") > 50, "done").when(C("value") > 1, "failed").alias("status"))
    g = spark.createDataFrame([("view", 60, 0, 30), ("click", 1440, 5, 30), ("signup", 30, 0, 2880), ("purchase", 2, 0, 30), ("refund", 1440, 0, 30)], "command string, every_minutes int, offset_minutes int, budget_minutes int")
    return quality.schedule_problems(e, g, "2024-01-08", "2024-01-20")


@query("t03_nightly_rollup", "SELECT user_id, event_type, count(*) AS live, count(*) AS counted, 0 AS drift FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def t03(spark, d):
    """The nightly recount of every live counter (t01), which overrides what the stream has added up."""
    events = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("counted"))
    live = engagement.live_counters(engagement.stream(spark, f"{d}/events.parquet"), "user_id", "event_type").withColumnRenamed("n", "live")
    j = live.join(events, ["user_id", "event_type"], "full")
    return j.select("user_id", "event_type", "live", "counted", (F.coalesce("live", F.lit(0)) - F.coalesce("counted", F.lit(0))).cast("int").alias("drift"))


@query("t05_expired_cache", "SELECT group_id, max(fetched_at) AS newest, count(*) FILTER (WHERE fetched_at < TIMESTAMP '2026-01-01') AS expired FROM live_venues GROUP BY 1")
def t05(spark, d):
    return table(spark, d, "live_venues").groupBy("group_id").agg(F.max("fetched_at").alias("newest"), F.count_if(C("fetched_at") < F.lit("2026-01-01").cast("timestamp")).alias("expired"))
