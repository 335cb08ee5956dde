"""Filters, joins, rankings and write plans that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.session import materialize


def nearby(df: DataFrame, lat: float, lng: float, radius_km: float, lat_col: str = "latitude", lng_col: str = "longitude") -> DataFrame:
    """Rows within ``radius_km`` of a point, with ``distance``. A box on the raw columns is pushed to the scan first.

    Rows without coordinates are left out. Coordinates count as recorded.
    """
    import math

    d_lat = radius_km * 1.1 / geo.KM_PER_DEGREE
    d_lng = d_lat / math.cos(math.radians(max(-89.9, min(89.9, lat))))
    kind = df.schema[lat_col].dataType, df.schema[lng_col].dataType
    box = F.col(lat_col).between(F.lit(lat - d_lat).cast(kind[0]), F.lit(lat + d_lat).cast(kind[0])) & F.col(lng_col).between(F.lit(lng - d_lng).cast(kind[1]), F.lit(lng + d_lng).cast(kind[1]))
    km = geo.cosine_law_km(F.lit(lat), F.lit(lng), F.col(lat_col).cast("double"), F.col(lng_col).cast("double"))
    return df.where(box).withColumn("distance", km).where(F.col("distance") <= radius_km)


def exact_duplicates(df: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """(keep, dupe): every row that equals an earlier one in ``key``, with the smallest id that it equals.

    One aggregate instead of all pairs, so a key of any weight is safe. Null keys equal nothing.
    """
    some = df.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    least = some.groupBy(*key).agg(F.min(row_id).alias("keep"))
    return some.join(least, list(key)).where(F.col(row_id) > F.col("keep")).select("keep", F.col(row_id).alias("dupe"))


def first_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def ranked(df: DataFrame, name: str, *order: Column, spread: int | None = None) -> DataFrame:
    """``df`` with its position (1, 2, ...) in a total order as ``name``.

    Rows are range-partitioned, ranked within their partition, stored with its number and shifted by the counts of the
    partitions before it, so no single task sorts the whole table and the counts are those of the rows they shift.
    Only one count per partition is gathered.
    """
    parts = df.repartitionByRange(spread, *order) if spread else df.repartitionByRange(*order)
    parts = parts.withColumn("_p", F.spark_partition_id())
    local, _ = materialize(parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranked")
    counts = local.groupBy("_p").agg(F.max("_r").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a sorted table with its rank and the totals a pager needs."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(number * size)
    rows = top.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > (number - 1) * size)
    return rows.crossJoin(F.broadcast(total)).withColumn("last_page", F.ceil(F.col("total") / size))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], newest: str) -> DataFrame:
    """Rows of both tables, one per key: the newest by ``newest``, ties to the new table."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = [c for c in old.columns if c not in key]
    best = both.groupBy(*key).agg(F.max(F.struct(F.col(newest), F.col("_new"), *[F.col(c).alias(f"v_{c}") for c in cols])).alias("b"))
    return best.select(*key, *[F.col(f"b.v_{c}").alias(c) for c in cols])


def patched(base: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``base`` with the non-null values of ``updates`` (one row per key) written over ``cols``."""
    u = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = base.join(u, base[key] == u["_k"], "left")
    return j.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns])


def recent_counts(df: DataFrame, events: DataFrame, row_id: str, event_id: str, at: str, as_of: str, days: int) -> DataFrame:
    """``df`` with ``recent``: its events of the last ``days``; pre-aggregated before the join."""
    edge = F.lit(as_of).cast("timestamp")
    n = events.where((F.col(at) > edge - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= edge)).groupBy(F.col(event_id).alias("_e")).agg(F.count("*").alias("_n"))
    return df.join(n, df[row_id] == n["_e"], "left").withColumn("recent", F.coalesce("_n", F.lit(0))).drop("_e", "_n")
