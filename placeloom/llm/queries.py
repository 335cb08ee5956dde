"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import addresses, components, entity_match, leakage, packing, pii, survivorship, topn
from placeloom.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_venues(table(spark, d, "restaurants"), table(spark, d, "places"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_venues(table(spark, d, "restaurants"), table(spark, d, "places"), least=0.5).select("restaurant_id", "place_id")


def _located(spark: SparkSession, d: str) -> DataFrame:
    parts, _ = materialize(addresses.parsed(table(spark, d, "restaurants"), "id", "address", "city", "state", "postal_code"), "addresses")
    return addresses.canonical(parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_location_pairs(_located(spark, d))


def p2_locations(spark: SparkSession, d: str) -> DataFrame:
    return addresses.location_classes(_located(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.hash_to_min(table(spark, d, "venue_matches"), "id_a", "id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "live_venues"), table(spark, d, "source_trust")).select("group_id", "field", "id")


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.golden_records(table(spark, d, "live_venues"), table(spark, d, "source_trust"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_venues(table(spark, d, "restaurants"), table(spark, d, "cuisine_restaurant"), table(spark, d, "cuisines")).select("city", "slug", "restaurant_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Room used by the tiers and, for comparison, by one tier: best-fit decreasing over all lengths."""
    sized = packing.sizes(table(spark, d, "documents"), "doc_id", "text")
    one = lambda n: packing.packing_report(packing.packed(sized, tiers=n)).select(F.lit(n).alias("tiers"), "*")
    return one(4).unionByName(one(1))


def p6_heavy(spark: SparkSession, d: str) -> DataFrame:
    """p6_found with a threshold so low that the common groups take the branch of heavy ones."""
    return topn.top_venues(table(spark, d, "restaurants"), table(spark, d, "cuisine_restaurant"), table(spark, d, "cuisines"), heavy_rows=20).select("city", "slug", "restaurant_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_matches": p1_matches, "p2_found": p2_found, "p2_locations": p2_locations, "p3_found": p3_found, "p4_found": p4_found, "p4_golden": p4_golden, "p6_found": p6_found, "p6_heavy": p6_heavy, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_redacted": p9_redacted}


P3_SQL = """
WITH RECURSIVE e AS (
  SELECT id_a AS a, id_b AS b FROM venue_matches WHERE id_a IS NOT NULL AND id_b IS NOT NULL
  UNION SELECT id_b, id_a FROM venue_matches WHERE id_a IS NOT NULL AND id_b IS NOT NULL
  UNION SELECT id_a, id_a FROM venue_matches WHERE id_a IS NOT NULL
  UNION SELECT id_b, id_b FROM venue_matches WHERE id_b IS NOT NULL
), r(id, o) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o)
SELECT id, min(o) AS group_id FROM r GROUP BY id
"""

P4_SQL = """
WITH l AS (
  SELECT v.group_id, f.field, v.id, v.updated_at, t.trust_rank,
         CASE f.field WHEN 'name' THEN v.name WHEN 'city' THEN v.city ELSE v.photo_url END AS value
  FROM live_venues v CROSS JOIN (VALUES ('name'), ('city'), ('photo_url')) f(field)
  LEFT JOIN source_trust t ON lower(trim(v.source)) = t.source
), u AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY trust_rank ASC NULLS LAST, updated_at DESC NULLS LAST, id) AS k
  FROM l WHERE value IS NOT NULL AND CASE field
    WHEN 'name' THEN lower(trim(value)) NOT IN ('', 'n/a', 'unknown', '-', '(no name)', 'test', 'null', 'name missing', '???', 'tbd', 'unnamed')
    WHEN 'city' THEN lower(trim(value)) NOT IN ('', '?', 'unknown', 'null', '-', '00000', 'city', 'n/a', 'none', 'not provided')
    ELSE regexp_matches(value, '^https?://[^/]+/.') AND NOT regexp_matches(value, '/(blank[.]gif|coming-soon[.]jpg|placeholder[.]png|no-image[.]jpg|photo_not_available[.]webp|default[.]png)$') END
)
SELECT group_id, field, id FROM u WHERE k = 1
"""

P6_SQL = """
WITH p AS (
  SELECT DISTINCT lower(trim(r.city)) AS city, c.slug, r.id, r.popularity_score
  FROM restaurants r JOIN cuisine_restaurant x ON x.restaurant_id = r.id JOIN cuisines c ON c.id = x.cuisine_id
  WHERE trim(r.city) <> ''
)
SELECT city, slug, id AS restaurant_id FROM (
  SELECT *, row_number() OVER (PARTITION BY city, slug ORDER BY popularity_score DESC NULLS LAST, id) AS k FROM p) WHERE k <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL, "p6_heavy": P6_SQL}
