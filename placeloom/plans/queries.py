"""Registered queries of the core engine and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeloom.operators.spatial_join import within_circles
from placeloom.plans import detail_queries, integration_queries, page_queries, relational_queries, scalar_queries, search_queries, stream_queries, venue_queries
from placeloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    fixes, zips = table(spark, d, "geolocation_fixes"), table(spark, d, "zip_centroids")
    return within_circles(fixes, "fix_id", "lat", "lng", zips, "zip", "lat", "lng", "radius_km").select("fix_id", "zip").distinct()


P5_SQL = """
SELECT DISTINCT f.fix_id, z.zip FROM geolocation_fixes f JOIN zip_centroids z
ON f.lat BETWEEN -90 AND 90 AND f.lng BETWEEN -180 AND 180 AND z.radius_km IS NOT NULL
AND 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(z.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(z.lat)) * power(sin(radians(z.lng - f.lng) / 2), 2)))) <= z.radius_km
"""


def queries() -> dict[str, Query]:
    return {"p5_found": p5_found} | scalar_queries.Q | relational_queries.Q | venue_queries.Q | stream_queries.Q | integration_queries.Q | detail_queries.Q | page_queries.Q | search_queries.Q


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL} | scalar_queries.SQL | relational_queries.SQL | venue_queries.SQL | stream_queries.SQL | integration_queries.SQL | detail_queries.SQL | page_queries.SQL | search_queries.SQL
