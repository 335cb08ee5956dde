"""Matching, merging, scoring, relevance and quality over whole venue tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import matching, quality, relevance, scoring
from placeloom.plans.relational_queries import AS_OF, tagged_venues
from placeloom.plans.scalar_queries import _CODES, _ROWS, ADDRESS_SQL
from placeloom.session import materialize, table

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


P10 = "CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END"


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return f"12742 * asin(least(1.0, sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


# matching and merging


@query("j07_grid_join", f"SELECT r.id, p.id AS place_id, round({km_sql('CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)', 'p.lat', 'p.lng')}, 6) AS km FROM restaurants r JOIN places p ON r.latitude <> 0 AND r.longitude <> 0 AND p.lat <> 0 AND p.lng <> 0 AND abs(r.latitude - p.lat) < 0.01 AND {km_sql('CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)', 'p.lat', 'p.lng')} <= 0.1")
def j07(spark, d):
    r = table(spark, d, "restaurants").select("id", C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    p = table(spark, d, "places").select(C("id").alias("place_id"), "lat", "lng")
    return matching.grid_pairs(r, p, 0.1).select("id", "place_id", F.round("km", 6).alias("km"))


def venue_pairs(spark, d):
    r = table(spark, d, "restaurants").select("id", "name", "phone", C("latitude").cast("double").alias("lat"), C("longitude").cast("double").alias("lng"))
    tails = F.array_compact(F.transform(F.coalesce("phones", F.array().cast("array<string>")), text.last_ten_digits))
    p = table(spark, d, "places").select(C("id").alias("place_id"), C("name").alias("place_name"), tails.alias("place_phones"), "lat", "lng")
    return r, p


@query("j07_nearest_place")
def j07n(spark, d):
    r, p = venue_pairs(spark, d)
    return matching.nearest_match(r, p).select("id", "place_id", "by_phone", F.round("km", 6).alias("km"))


@query("j12_nearest_by_phone", f"""
WITH r AS (SELECT id, {P10} AS p, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lng FROM restaurants WHERE latitude <> 0 AND longitude <> 0),
q AS (SELECT id AS place_id, unnest(phones) AS phone, lat, lng FROM places WHERE lat <> 0 AND lng <> 0)
SELECT id, place_id FROM (SELECT r.id, q.place_id, row_number() OVER (PARTITION BY r.id ORDER BY abs(r.lat - q.lat) + abs(r.lng - q.lng), q.place_id) AS k FROM r JOIN q ON r.p = {P10.replace('phone', 'q.phone')} WHERE {km_sql('r.lat', 'r.lng', 'q.lat', 'q.lng')} <= 0.2) WHERE k = 1""")
def j12(spark, d):
    r, p = venue_pairs(spark, d)
    r = r.where(geo.known(C("lat"), C("lng"))).select("id", text.last_ten_digits(C("phone")).alias("ph"), "lat", "lng")
    p = p.where(geo.known(C("lat"), C("lng"))).select("place_id", F.explode("place_phones").alias("ph"), C("lat").alias("p_lat"), C("lng").alias("p_lng"))
    j = r.join(p, "ph").where(geo.haversine_asin_km(C("lat"), C("lng"), C("p_lat"), C("p_lng")) <= 0.2)
    return j.groupBy("id").agg(F.min_by("place_id", F.struct((F.abs(C("lat") - C("p_lat")) + F.abs(C("lng") - C("p_lng"))).alias("l1"), "place_id")).alias("place_id"))


@query("m01_same_venue_pairs")
def m01(spark, d):
    v = table(spark, d, "restaurants").select(C("id").alias("ord"), "name", "phone", C("latitude").alias("lat"), C("longitude").alias("lng"))
    return matching.same_venue_edges(v)


@query("m02_greedy_dedup")
def m02(spark, d):
    v = table(spark, d, "restaurants").select(C("id").alias("ord"), "name", "phone", C("latitude").alias("lat"), C("longitude").alias("lng"))
    return matching.greedy_anchors(v.select("ord"), matching.same_venue_edges(v))


_FIRST = lambda f, ok: f"(list(v.{f} ORDER BY v.ord, v.id) FILTER (WHERE {ok}))[1] AS {f}"


@query("m03_merged_groups", f"""
WITH v AS (SELECT DISTINCT * FROM live_venues)
SELECT group_id, {', '.join(_FIRST(f, f"v.{f} IS NOT NULL AND v.{f} <> ''") for f in ('name', 'address', 'city', 'phone'))},
  CAST((list(v.google_rating ORDER BY v.ord, v.id) FILTER (WHERE v.google_rating > 0))[1] AS DOUBLE) AS google_rating,
  coalesce((list(v.google_review_count ORDER BY v.ord, v.id) FILTER (WHERE v.google_rating > 0))[1], (list(v.google_review_count ORDER BY v.ord, v.id) FILTER (WHERE v.google_review_count IS NOT NULL))[1]) AS google_review_count
FROM v GROUP BY group_id""")
def m03(spark, d):
    v = table(spark, d, "live_venues").distinct().withColumn("_o", F.struct("ord", "id"))
    m = matching.merged(v, "group_id", "_o", ["name", "address", "city", "phone"], [("google_rating", "google_review_count")])
    return m.withColumn("google_rating", C("google_rating").cast("double"))


@query("m04_overlay", f"""
WITH l AS (SELECT id, name, phone, photo_url, google_rating, {P10} AS p, city, row_number() OVER (PARTITION BY {P10}, lower(trim(city, ' ')) ORDER BY ord DESC, id DESC, photo_url DESC NULLS LAST) AS k FROM live_venues WHERE {P10} IS NOT NULL)
SELECT r.id, coalesce(nullif(l.name, ''), r.name) AS name, coalesce(nullif(l.photo_url, ''), r.photo_url) AS photo_url, CAST(CASE WHEN l.google_rating > 0 THEN l.google_rating ELSE r.google_rating END AS DOUBLE) AS google_rating
FROM restaurants r LEFT JOIN l ON l.k = 1 AND l.p = {P10.replace('phone', 'r.phone')} AND lower(trim(l.city, ' ')) = lower(trim(r.city, ' '))""")
def m04(spark, d):
    live = table(spark, d, "live_venues").select(text.last_ten_digits(C("phone")).alias("p"), F.lower(F.trim("city")).alias("c"), "ord", "id", "name", "photo_url", "google_rating").where("p IS NOT NULL")
    last = live.groupBy("p", "c").agg(F.max_by(F.struct(C("name").alias("l_name"), C("photo_url").alias("l_photo"), C("google_rating").alias("l_rating")), F.struct("ord", "id", "photo_url")).alias("l")).select("p", "c", "l.*")
    r = table(spark, d, "restaurants").withColumn("p", text.last_ten_digits(C("phone"))).withColumn("c", F.lower(F.trim("city")))
    value = lambda new, old: F.coalesce(F.when(C(new) != "", C(new)), C(old))
    return r.join(last, ["p", "c"], "left").select("id", value("l_name", "name").alias("name"), value("l_photo", "photo_url").alias("photo_url"), F.when(C("l_rating") > 0, C("l_rating")).otherwise(C("google_rating")).cast("double").alias("google_rating"))


@query("m10_repointed_links", """
WITH m AS (SELECT r.id AS dupe, k.keep FROM restaurants r JOIN (SELECT name, city, latitude, longitude, min(id) AS keep FROM restaurants WHERE name IS NOT NULL AND city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3, 4) k USING (name, city, latitude, longitude) WHERE r.id > k.keep)
SELECT DISTINCT coalesce(m.keep, x.restaurant_id) AS restaurant_id, x.cuisine_id FROM cuisine_restaurant x LEFT JOIN m ON m.dupe = x.restaurant_id""")
def m10(spark, d):
    from placeloom.operators.relational import exact_duplicates

    m = exact_duplicates(table(spark, d, "restaurants").select("id", "name", "city", "latitude", "longitude"), ["name", "city", "latitude", "longitude"], "id").select("keep", C("dupe").alias("restaurant_id"))
    return table(spark, d, "cuisine_restaurant").join(m, "restaurant_id", "left").select(F.coalesce("keep", "restaurant_id").alias("restaurant_id"), "cuisine_id").distinct()


@query("m11_phone_city_groups", f"SELECT min(id) AS keep, count(*) AS n, CAST(sum(total_engagement) AS BIGINT) AS engagement FROM (SELECT *, {P10} AS p FROM restaurants) WHERE p IS NOT NULL AND city IS NOT NULL GROUP BY p, lower(trim(city, ' ')) HAVING count(*) > 1")
def m11(spark, d):
    r = table(spark, d, "restaurants").withColumn("p", text.last_ten_digits(C("phone"))).where("p IS NOT NULL AND city IS NOT NULL")
    return r.groupBy("p", F.lower(F.trim("city")).alias("c")).agg(F.min("id").alias("keep"), F.count("*").alias("n"), F.sum("total_engagement").alias("engagement")).where("n > 1").select("keep", "n", "engagement")


@query("m17_metadata_merge", "SELECT p.category, string_agg(DISTINCT x, ',' ORDER BY x) AS sources FROM (SELECT category, unnest(datasets) AS x FROM places) p GROUP BY 1")
def m17(spark, d):
    return table(spark, d, "places").select("category", F.explode("datasets").alias("x")).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("sources"))


@query("x04_likeness")
def x04(spark, d):
    r, p = venue_pairs(spark, d)
    pairs = matching.grid_pairs(r.select("id", C("name").alias("a"), "lat", "lng"), p.select("place_id", C("place_name").alias("b"), "lat", "lng"), 0.05)
    return pairs.select("id", "place_id", F.round(matching.likeness(F.lower("a"), F.lower("b")), 4).alias("percent"))


# scoring

_COUNT_SIGNALS = {"website_clicks_count": 0.20, "pageviews_count": 0.10, "social_link_clicks_count": 0.05, "menu_click_count": 0.05, "directions_clicks_count": 0.05, "call_clicks_count": 0.05}


def score_sql(rows: str = "SELECT *, NULL::DOUBLE AS distance FROM restaurants", quality_weight: float = 0.35) -> str:
    """CTEs n (signals as rows: id, i, signal, w, v) and t (id, raw, total) over ``rows``."""
    seen = ("website_clicks_count", "pageviews_count")
    den = ", ".join(f"CAST(coalesce(greatest(max({c}) FILTER (WHERE {c} > 0), 500), 5000) AS DOUBLE) AS den_{c}" for c in seen)
    unit = lambda x: f"greatest(0.0, least(1.0, {x}))"
    counts = " ".join(f"UNION ALL SELECT id, {6 + i}, '{c}', {w}, {unit(f'ln(1 + coalesce({c}, 0)) / ln(1 + den_{c})') if c in seen else '0.0'} FROM s" for i, (c, w) in enumerate(_COUNT_SIGNALS.items()))
    filled = " + ".join([*(f"CASE WHEN trim(coalesce({f}, ''), ' ') <> '' THEN 1 ELSE 0 END" for f in ("name", "address", "phone", "price_range", "website_url", "photo_url")), "CASE WHEN coalesce(latitude, 0) <> 0 THEN 1 ELSE 0 END", "CASE WHEN coalesce(longitude, 0) <> 0 THEN 1 ELSE 0 END"])
    return f"""
b AS ({rows}),
m AS (SELECT coalesce(avg(CAST(google_rating AS DOUBLE)) FILTER (WHERE google_rating > 0 AND google_review_count >= 50 AND latitude <> 0 AND longitude <> 0), 4.0) AS c, {den} FROM b),
s AS (SELECT b.*, m.*, coalesce(google_rating > 0, false) AS rated, CAST(google_review_count AS DOUBLE) AS v FROM b, m),
n AS (SELECT id, 0 AS i, 'quality' AS signal, {quality_weight} AS w, {unit('(coalesce(v, 0) / (coalesce(v, 0) + 50) * CAST(google_rating AS DOUBLE) + 50 / (coalesce(v, 0) + 50) * c) / 5')} AS v FROM s WHERE rated
UNION ALL SELECT id, 1, 'evidence', 0.35, CAST(round(CAST(0.85 * (0.20 * {unit('coalesce(CAST(overture_confidence AS DOUBLE), 0.0)')} + 0.20 * CASE WHEN trim(coalesce(website_url, ''), ' ') <> '' THEN 0.3 ELSE 0.0 END) AS DECIMAL(18, 12)), 4) AS DOUBLE) FROM s WHERE NOT rated
UNION ALL SELECT id, 2, 'proximity', 0.15, {unit('1 / (1 + distance / 2.0)')} FROM s WHERE distance >= 0
UNION ALL SELECT id, 3, 'data_completeness', 0.05, round(({filled}) / 10.0, 4) FROM s
UNION ALL SELECT id, 4, 'has_award', 0.05, 1.0 FROM s WHERE has_award {counts}),
t AS (SELECT id, sum(w * v) AS raw, sum(w) AS total FROM n GROUP BY id)
"""


_ROUNDED = "CAST(round(CAST(raw / total AS DECIMAL(18, 12)), 4) AS DOUBLE)"


@query("r01_scores", f"WITH {score_sql()} SELECT id, {_ROUNDED} AS score FROM t")
def r01(spark, d):
    r = table(spark, d, "restaurants")
    return scoring.scored(r, scoring.collection_stats(r)).select("id", "score")


@query("r04_credible_mean", "SELECT round(coalesce(avg(CAST(google_rating AS DOUBLE)) FILTER (WHERE google_rating > 0 AND google_review_count >= 50 AND latitude <> 0 AND longitude <> 0), 4.0), 6) AS mean_rating, CAST(coalesce(greatest(max(pageviews_count) FILTER (WHERE pageviews_count > 0), 500), 5000) AS DOUBLE) AS den_pageviews_count FROM restaurants")
def r04(spark, d):
    return scoring.collection_stats(table(spark, d, "restaurants")).select(F.round("mean_rating", 6).alias("mean_rating"), "den_pageviews_count")


@query("r11_breakdown", f"WITH {score_sql()} SELECT n.id, CAST(row_number() OVER (PARTITION BY n.id ORDER BY round(w * v / total, 6) DESC, i) - 1 AS INTEGER) AS pos, signal, round(w / total, 6) AS weight, round(v, 6) AS normalized, round(w * v / total, 6) AS contribution FROM n JOIN t USING (id)")
def r11(spark, d):
    r = table(spark, d, "restaurants")
    s = scoring.scored(r, scoring.collection_stats(r), breakdown=True)
    return s.select("id", F.posexplode("breakdown").alias("pos", "b")).select("id", "pos", "b.*")


_NEAR = "SELECT * FROM (SELECT *, 6371.0 * acos(greatest(-1.0, least(1.0, cos(radians(43.0)) * cos(radians(CAST(latitude AS DOUBLE))) * cos(radians(CAST(longitude AS DOUBLE)) - radians(-114.1)) + sin(radians(43.0)) * sin(radians(CAST(latitude AS DOUBLE)))))) AS distance FROM restaurants WHERE latitude IS NOT NULL AND longitude IS NOT NULL) WHERE distance <= 25.0"


@query("r13_scoped_scores", f"WITH {score_sql(_NEAR)} SELECT id, {_ROUNDED} AS score, round(distance, 6) AS distance FROM t JOIN b USING (id)")
def r13(spark, d):
    from placeloom.operators.relational import nearby

    # aggregates come from the result set, not the corpus
    near = nearby(table(spark, d, "restaurants"), 43.0, -114.1, 25.0)
    return scoring.scored(near, scoring.collection_stats(near)).select("id", "score", F.round("distance", 6).alias("distance"))


@query("r14_what_if", f"SELECT a.id, a.score AS now, z.score AS then, round(z.score - a.score, 4) AS change FROM (WITH {score_sql()} SELECT id, {_ROUNDED} AS score FROM t) a JOIN (WITH {score_sql(quality_weight=0.6)} SELECT id, {_ROUNDED} AS score FROM t) z USING (id)")
def r14(spark, d):
    r = table(spark, d, "restaurants")
    stats = scoring.collection_stats(r)
    other = scoring.ScoringConfig(weights={**scoring.WEIGHTS, "quality": 0.6})
    return scoring.scored(scoring.scored(r, stats).withColumnRenamed("score", "now"), stats, other).select("id", "now", C("score").alias("then"), F.round(C("score") - C("now"), 4).alias("change"))


# relevance

LEXICON = {"thai": ["thai", "pad thai"], "japanese": ["japanese", "ramen", "izakaya"], "sushi": ["sushi", "nigiri"], "italian": ["italian", "pizzeria", "trattoria"], "mexican": ["mexican", "taqueria", "taco"], "bakery": ["bakery", "bread"]}
CATEGORIES = {"asian": ["thai", "japanese", "sushi"]}


@query("m07_match_strength", r"""
WITH t AS (SELECT x.restaurant_id, bool_or(c.slug IN ('thai', 'japanese', 'sushi')) AS tagged FROM cuisine_restaurant x JOIN cuisines c ON c.id = x.cuisine_id GROUP BY 1)
SELECT r.id, CASE WHEN t.tagged OR regexp_matches(lower(r.name), '\b(izakaya|japanese|nigiri|pad thai|ramen|sushi|thai)') THEN 1.0 WHEN regexp_matches(lower(concat_ws(' ', array_to_string(r.place_types, ' '), r.description)), '\b(izakaya|japanese|nigiri|pad thai|ramen|sushi|thai)') THEN 0.5 ELSE 0.0 END AS strength FROM restaurants r LEFT JOIN t ON t.restaurant_id = r.id""")
def m07(spark, d):
    scope = relevance.resolve("asian", LEXICON, CATEGORIES)
    tags = tagged_venues(spark, d).groupBy(C("restaurant_id").alias("id")).agg(F.collect_set("slug").alias("slugs"))
    r = table(spark, d, "restaurants").withColumn("types", F.array_join("place_types", " ")).join(tags, "id", "left")
    return r.select("id", relevance.match_strength(scope, C("slugs"), C("name"), relevance.text_of("types", "description")).alias("strength"))


@query("m08_rival_evidence", r"SELECT id FROM restaurants WHERE regexp_matches(lower(concat_ws(' ', array_to_string(place_types, ' '), description)), '\b(bakery|bread|italian|mexican|pizzeria|taco|taqueria|trattoria)')")
def m08(spark, d):
    scope = relevance.resolve("asian", LEXICON, CATEGORIES)
    return table(spark, d, "restaurants").withColumn("types", F.array_join("place_types", " ")).where(relevance.text_of("types", "description").rlike(scope.rival)).select("id")


_HITS = "CASE slug " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"{f} * len(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '\\b({'|'.join(v)})')))" for f, c in ((1.0, "name"), (0.5, "description"))) for k, v in LEXICON.items()) + " ELSE 0.0 END"


@query("m09_audited_tags", f"""
WITH t AS (SELECT DISTINCT x.restaurant_id, x.cuisine_id FROM cuisine_restaurant x),
g AS (SELECT r.id, c.slug, r.name, r.description FROM t JOIN cuisines c ON c.id = t.cuisine_id JOIN restaurants r ON r.id = t.restaurant_id),
h AS (SELECT id, slug, CAST({_HITS} AS DOUBLE) AS hits FROM g)
SELECT id, slug, hits, count(*) OVER (PARTITION BY id) < 3 OR row_number() OVER (PARTITION BY id ORDER BY hits DESC, slug) = 1 AS kept FROM h""")
def m09(spark, d):
    r = table(spark, d, "restaurants").select(C("id").alias("restaurant_id"), "name", "description")
    t = tagged_venues(spark, d).join(r, "restaurant_id").select(C("restaurant_id").alias("id"), "slug", F.lit(1).alias("category"), "name", "description")
    return relevance.audited_tags(t, LEXICON)


_SAYS = {k: f"regexp_matches(lower(concat_ws(' ', name, description)), '\\b({'|'.join(v)})')" for k, v in LEXICON.items()}
_OWN = "CASE slug " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SAYS.items()) + " ELSE true END"
_RIVAL = " OR ".join(f"(slug <> '{k}' AND {v})" for k, v in _SAYS.items())


@query("m09_contradicted_tags", f"WITH g AS (SELECT DISTINCT r.id, c.slug, r.name, r.description FROM cuisine_restaurant x JOIN cuisines c ON c.id = x.cuisine_id JOIN restaurants r ON r.id = x.restaurant_id) SELECT id, slug FROM g WHERE NOT ({_OWN}) AND ({_RIVAL})")
def m09c(spark, d):
    """Tags that no word of the venue speaks for while words of another cuisine stand there."""
    r = table(spark, d, "restaurants").select(C("id").alias("restaurant_id"), F.lower(F.concat_ws(" ", "name", "description")).alias("t"))
    g = tagged_venues(spark, d).join(r, "restaurant_id")
    says = {k: C("t").rlike(r"\b(" + "|".join(v) + ")") for k, v in LEXICON.items()}
    own, rival = F.lit(True), F.lit(False)
    for k, hit in says.items():
        own = F.when(C("slug") == k, hit).otherwise(own)
        rival = rival | ((C("slug") != k) & hit)
    return g.where(~own & rival).select(C("restaurant_id").alias("id"), "slug").distinct()


# quality


@query("d03_host_brands", r"SELECT regexp_replace(lower(regexp_extract(website_url, '^https?://([^/?#:]+)', 1, 'i')), '^www\.', '') AS host, count(DISTINCT id) AS venues, count(DISTINCT lower(trim(city, ' '))) AS cities FROM restaurants WHERE website_url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) >= 5")
def d03(spark, d):
    r = table(spark, d, "restaurants").where("website_url IS NOT NULL")
    return r.groupBy(text.url_host(C("website_url")).alias("host")).agg(F.countDistinct("id").alias("venues"), F.countDistinct(F.lower(F.trim("city"))).alias("cities")).where("venues >= 5")


_NK = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' ')"


_ST = "CASE WHEN upper(trim(state, ' ')) IN (" + ", ".join(f"'{c}'" for c, _ in _ROWS) + ") THEN upper(trim(state, ' ')) " + " ".join(f"WHEN lower(trim(state, ' ')) = '{n}' THEN '{c}'" for c, n in _ROWS) + " END"
_AREAS = f"""
r0 AS (SELECT *, {_NK} AS nk, {P10} AS p, {_ST} AS st, lower(trim(city, ' ')) AS ck FROM restaurants),
h AS (SELECT area, st AS home FROM (SELECT substr(p, 1, 3) AS area, st, row_number() OVER (PARTITION BY substr(p, 1, 3) ORDER BY count(*) DESC, st DESC) AS k FROM r0 WHERE p IS NOT NULL AND st IS NOT NULL GROUP BY substr(p, 1, 3), st) WHERE k = 1)
"""
_COPIED = f"""
{_AREAS},
c AS (SELECT r0.id, nk, google_rating AS gr, coalesce(google_review_count, -1) AS gc, ck, p, coalesce(home = st, false) AS here FROM r0 LEFT JOIN h ON h.area = substr(p, 1, 3) WHERE is_active AND google_rating > 0),
m AS (SELECT nk, gr, gc FROM c WHERE nk IS NOT NULL GROUP BY ALL HAVING count(DISTINCT ck) > 1),
k AS (SELECT c.* FROM c JOIN m USING (nk, gr, gc)),
sh AS (SELECT nk, gr, gc, p, min(id) FILTER (WHERE here) AS id FROM k WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND count(*) FILTER (WHERE here) = 1),
f AS (SELECT nk, gr, gc, arg_min(id, p) AS by_phone FROM sh GROUP BY ALL),
l AS (SELECT nk, gr, gc, CASE WHEN count(*) FILTER (WHERE here) = 1 THEN min(id) FILTER (WHERE here) END AS alone FROM k GROUP BY ALL),
o AS (SELECT l.nk, l.gr, l.gc, coalesce(f.by_phone, l.alone) AS owner FROM l LEFT JOIN f USING (nk, gr, gc)),
bad AS (SELECT k.id, o.owner FROM k JOIN o USING (nk, gr, gc) WHERE o.owner IS NULL OR o.owner <> k.id)
"""


@query("d04_copied_ratings", f"WITH {_COPIED} SELECT id, 'google_rating' AS field, 'copied rating' AS reason, CAST(owner AS VARCHAR) AS detail FROM bad")
def d04(spark, d):
    return quality.copied_ratings(table(spark, d, "restaurants"))


@query("d05_copied_phones", f"""
WITH {_AREAS},
m AS (SELECT nk, p FROM r0 WHERE is_active AND p IS NOT NULL AND nk IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT ck) > 1)
SELECT r0.id, 'phone' AS field, 'copied phone' AS reason, h.home AS detail FROM r0 JOIN m USING (nk, p) JOIN h ON h.area = substr(r0.p, 1, 3) WHERE is_active AND (st IS NULL OR st <> home)""")
def d05(spark, d):
    return quality.copied_phones(table(spark, d, "restaurants"))


_ZIP_NAMED = f"""
{ADDRESS_SQL},
z AS (SELECT id, CASE WHEN regexp_matches(w[-1], '^\\d{{5}}(-\\d{{4}})?$') AND NOT (n = 2 AND len(w) = 1 AND NOT regexp_matches(p[1], '^\\d')) THEN left(w[-1], 5) END AS a_zip, CASE WHEN regexp_matches(trim(postal_code, ' '), '^\\d{{5}}(-\\d{{4}})?$') THEN left(trim(postal_code, ' '), 5) END AS p_zip,
  CASE WHEN regexp_matches(p[-2], '^[A-Za-z][A-Za-z .''-]+$') AND regexp_matches(w[1], '^[A-Z][A-Z]$') AND w[1] IN ({_CODES}) AND ((len(w) = 2 AND n >= 2 AND regexp_matches(w[2], '^\\d{{5}}(-\\d{{4}})?$')) OR (len(w) = 1 AND n >= 3)) THEN w[1] END AS named FROM w)
"""


@query("d06_foreign_state", f"""
WITH {_ZIP_NAMED}, s AS (SELECT id, latitude, longitude, {_ST} AS st FROM restaurants)
SELECT s.id, 'address' AS field, 'names another state' AS reason, z.named AS detail FROM s JOIN z USING (id) LEFT JOIN zip_centroids q ON q.zip = z.a_zip
WHERE z.named <> s.st AND NOT coalesce(s.latitude <> 0 AND s.longitude <> 0 AND {km_sql('q.lat', 'q.lng', 'CAST(s.latitude AS DOUBLE)', 'CAST(s.longitude AS DOUBLE)')} <= 50, false)""")
def d06(spark, d):
    return quality.foreign_state_addresses(table(spark, d, "restaurants"), table(spark, d, "zip_centroids"))


@query("d06_swapped_states", f"""
WITH {_ZIP_NAMED}, s AS (SELECT id, latitude, longitude, 'IA' AS st FROM restaurants)
SELECT s.id, 'address' AS field, 'names another state' AS reason, z.named AS detail FROM s JOIN z USING (id) LEFT JOIN zip_centroids q ON q.zip = z.a_zip
WHERE z.named <> s.st AND NOT coalesce(s.latitude <> 0 AND s.longitude <> 0 AND {km_sql('q.lat', 'q.lng', 'CAST(s.latitude AS DOUBLE)', 'CAST(s.longitude AS DOUBLE)')} <= 50, false)""")
def d06s(spark, d):
    """The same with every row's state set to one, so that most addresses name another."""
    return quality.foreign_state_addresses(table(spark, d, "restaurants").withColumn("state", F.lit("Iowa")), table(spark, d, "zip_centroids"))


@query("d07_far_zips", f"""
WITH {_ZIP_NAMED}
SELECT r.id, 'postal_code' AS field, 'far from pin' AS reason, q.zip AS detail FROM restaurants r JOIN z USING (id) JOIN zip_centroids q ON q.zip = coalesce(z.a_zip, z.p_zip)
WHERE r.latitude <> 0 AND r.longitude <> 0 AND {km_sql('q.lat', 'q.lng', 'CAST(r.latitude AS DOUBLE)', 'CAST(r.longitude AS DOUBLE)')} > greatest(50, 3 * coalesce(q.radius_km, 0))""")
def d07(spark, d):
    return quality.far_zips(table(spark, d, "restaurants"), table(spark, d, "zip_centroids"))


@query("d01_blocked_hosts", r"SELECT id, 'website_url' AS field, 'blocked host' AS reason, h AS detail FROM (SELECT id, regexp_replace(lower(regexp_extract(website_url, '^https?://([^/?#:]+)', 1, 'i')), '^www\.', '') AS h FROM restaurants) WHERE h IN ('wok-parade.test', 'townplates.example') OR h LIKE '%.wok-parade.test' OR h LIKE '%.townplates.example'")
def d01(spark, d):
    return quality.blocked_websites(table(spark, d, "restaurants"), ["wok-parade.test", "townplates.example"])


_LIM = lambda c, a, b: f"CASE WHEN {c} IS NOT NULL THEN greatest({a}, least({b}, CAST({c} AS DOUBLE))) END"


@query("d14_normalized", rf"SELECT id, left(trim(regexp_replace(name, '\s+', ' ', 'g'), ' '), 255) AS name, trim(regexp_replace(city, '\s+', ' ', 'g'), ' ') AS city, coalesce({_ST}, trim(state, ' ')) AS state, {P10} AS phone, round({_LIM('google_rating', '0.0', '5.0')}, 1) AS google_rating, {_LIM('latitude', '-90.0', '90.0')} AS latitude, {_LIM('longitude', '-180.0', '180.0')} AS longitude, greatest(0, google_review_count) AS google_review_count FROM restaurants")
def d14(spark, d):
    return quality.normalized(table(spark, d, "restaurants"))


@query("k09_quarantine_view", f"WITH {_COPIED} SELECT r.id, CAST(CASE WHEN bad.id IS NULL THEN r.google_rating END AS DOUBLE) AS google_rating FROM restaurants r LEFT JOIN bad USING (id)")
def k09(spark, d):
    r = table(spark, d, "restaurants")
    view, _ = quality.quarantine(r.select("id", "google_rating"), quality.copied_ratings(r), ["google_rating"])
    return view.withColumn("google_rating", C("google_rating").cast("double"))


@query("d11_restored", "SELECT id, CAST(google_rating AS DOUBLE) AS google_rating FROM restaurants")
def d11(spark, d):
    """What the log keeps puts back all that the view lost."""
    r = table(spark, d, "restaurants").withColumn("google_rating", C("google_rating").cast("double"))
    view, log = quality.quarantine(r.select("id", "google_rating"), quality.copied_ratings(table(spark, d, "restaurants")), ["google_rating"])
    return quality.restored(view, log, ["google_rating"])


@query("s12_fresh_cache", f"SELECT source, count(*) AS n FROM live_venues WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1")
def s12(spark, d):
    edge = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 90 DAYS")
    return table(spark, d, "live_venues").where(C("fetched_at") >= edge).groupBy("source").agg(F.count("*").alias("n"))


@query("s13_cached_payloads", "SELECT group_id, id, name, phone FROM live_venues WHERE group_id IS NOT NULL")
def s13(spark, d):
    # one JSON document for every hundred places of a group's order, written and read again as a cache would hold it
    v = table(spark, d, "live_venues").where("group_id IS NOT NULL")
    docs = v.groupBy("group_id", F.floor(C("ord") / 100).alias("chunk")).agg(F.to_json(F.collect_list(F.struct("id", "name", "phone"))).alias("data"))
    return docs.select("group_id", F.explode(F.from_json("data", "array<struct<id:long,name:string,phone:string>>")).alias("v")).select("group_id", "v.*")


@query("s16_area_argmax", "SELECT city, state FROM (SELECT city, state, row_number() OVER (PARTITION BY city ORDER BY sum(CAST(total_engagement AS BIGINT)) DESC, state DESC) AS k FROM restaurants WHERE city IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def s16(spark, d):
    g = table(spark, d, "restaurants").where("city IS NOT NULL AND state IS NOT NULL").groupBy("city", "state").agg(F.sum("total_engagement").alias("area"))
    return g.groupBy("city").agg(F.max_by("state", F.struct("area", "state")).alias("state"))


@query("s17_alias_fanout", "SELECT alias, count(*) AS zips, round(max(km), 6) AS km FROM (SELECT unnest([substr(zip, 1, 3), substr(zip, 1, 2)]) AS alias, sqrt(radius_km * radius_km / pi()) AS km FROM zip_centroids) GROUP BY 1")
def s17(spark, d):
    z = table(spark, d, "zip_centroids").select(F.explode(F.array(F.left("zip", F.lit(3)), F.left("zip", F.lit(2)))).alias("alias"), F.sqrt(C("radius_km") * C("radius_km") / F.pi()).alias("km"))
    return z.groupBy("alias").agg(F.count("*").alias("zips"), F.round(F.max("km"), 6).alias("km"))


@query("s02_nested_scan", "SELECT id, city, coalesce(len(datasets), 0) AS sources FROM places WHERE lat BETWEEN 30 AND 45")
def s02(spark, d):
    from placeloom.sources.places import flattened, nested

    # the directory's nested release is written once and read with nested pruning
    path = materialize(nested(table(spark, d, "places")), "release")[1]
    return flattened(spark.read.parquet(path)).where("lat BETWEEN 30 AND 45").select("id", "city", F.size("datasets").alias("sources"))
