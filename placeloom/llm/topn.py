"""Top N items within every group, safe for groups of any size.

Exact group counts split the input. Light groups take an ordinary ranking window. Rows of heavy
groups are range-partitioned on (group, score, tie): a heavy group then spans many tasks, each
keeps its first N per group, and the few that remain are ranked once more. Both parts use the
same order, so the union is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small

HEAVY_ROWS = 10_000


def top_n_per_group(rows: DataFrame, group: Sequence[str], score: str, tie: str, n: int = 5, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The rows of ``rows`` that rank 1..n in their group, with the rank as ``_rank``.

    Larger ``score`` first, null scores last; equal scores go by the smaller ``tie``, which must be
    unique within a group for a stable result. Groups with a null key are groups like any other.
    Fewer than n rows: all of them. Empty in, empty out.
    """
    group = list(group)
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    # at most rows / heavy_rows groups are heavy
    heavy = rows.groupBy(*group).count().where(F.col("count") > heavy_rows).select(*[F.col(c).alias(f"_h_{c}") for c in group], F.lit(True).alias("_heavy"))
    on = [rows[c].eqNullSafe(heavy[f"_h_{c}"]) for c in group]
    tagged = rows.join(heavy, on, "left").drop(*[f"_h_{c}" for c in group])
    light = tagged.where("_heavy IS NULL").withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n)
    spread = tagged.where("_heavy").repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id())
    first = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))).where(F.col("_rank") <= n).drop("_part")
    last = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n)
    return light.unionByName(last).drop("_heavy")


def top_venues(restaurants: DataFrame, links: DataFrame, cuisines: DataFrame, n: int = 5, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(city, slug, restaurant_id, popularity_score, _rank): the n best venues of each city and cuisine.

    The city is lowered and stripped of outer spaces; null and blank cities form no group. A venue
    that is linked to a cuisine by several rows counts once.
    """
    r = restaurants.select(F.col("id").alias("restaurant_id"), F.lower(F.trim("city")).alias("city"), "popularity_score").where("city <> '' AND restaurant_id IS NOT NULL")
    tags = broadcast_if_small(cuisines.where("slug IS NOT NULL").select(F.col("id").alias("cuisine_id"), "slug"))
    # one aggregate makes links and venues distinct
    rows = links.select("restaurant_id", "cuisine_id").join(tags, "cuisine_id").join(r, "restaurant_id").groupBy("city", "slug", "restaurant_id").agg(F.max("popularity_score").alias("popularity_score"))
    return top_n_per_group(rows, ["city", "slug"], "popularity_score", "restaurant_id", n, heavy_rows)
