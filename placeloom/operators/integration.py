"""Folding live records into stored venues: keys in order of precedence, fill policies and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators.matching import grid_pairs, likeness


def first_key_match(live: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(live_id, stored_id, rule): for each live row the stored row it folds into.

    ``live`` has live_id, ``stored`` has stored_id and both have the key columns. Keys are tried in order; within a key the
    smallest stored id wins. One aggregate over the union of the equi-joins, so a row is never compared with all.
    """
    out = None
    for i, k in enumerate(keys):
        least = stored.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(k).agg(F.min("stored_id").alias("stored_id"))
        hit = live.select("live_id", k).join(least, k).select("live_id", F.struct(F.lit(i).alias("i"), F.col("stored_id"), F.lit(k).alias("rule")).alias("m"))
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy("live_id").agg(F.min("m").alias("m"))
    return best.select("live_id", "m.stored_id", "m.rule")


def nearby_alike(live: DataFrame, stored: DataFrame, km: float = 0.2, percent: float = 85.0) -> DataFrame:
    """(live_id, stored_id): the smallest stored id within ``km`` whose name (column n) is alike to ``percent``."""
    pairs = grid_pairs(live.select("live_id", F.col("n").alias("a"), "lat", "lng"), stored.select("stored_id", F.col("n").alias("b"), "lat", "lng"), km).where("a <> '' AND b <> ''")
    short, long = F.least(F.octet_length("a"), F.octet_length("b")), F.octet_length("a") + F.octet_length("b")
    pairs = pairs.where((F.col("a") == F.col("b")) | ((200.0 * short / long >= percent) & (F.when(F.col("a") != F.col("b"), likeness(F.col("a"), F.col("b"))).otherwise(F.lit(100.0)) >= percent)))
    return pairs.groupBy("live_id").agg(F.min("stored_id").alias("stored_id"))


def fold(live: DataFrame, stored: DataFrame, keys: Sequence[str], km: float = 0.2, percent: float = 85.0) -> DataFrame:
    """(live_id, stored_id, rule) of every live row; both null where none of the keys nor a near, alike name matches.

    live: live_id, n, lat, lng and the keys; stored: stored_id, n, lat, lng and the keys.
    """
    by_key = first_key_match(live, stored, keys)
    rest = live.join(by_key.select("live_id"), "live_id", "left_anti")
    found = by_key.unionByName(nearby_alike(rest, stored, km, percent).withColumn("rule", F.lit("near")))
    return live.select("live_id").distinct().join(found, "live_id", "left")


def filled_from(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], tag: Column, provenance: str = "field_sources") -> DataFrame:
    """``stored`` with its blank ``fields`` filled from ``incoming`` (one row per key) and each fill noted in the provenance map."""
    u = incoming.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_i_{f}") for f in fields], tag.alias("_tag"))
    j = stored.join(u, stored[key] == u["_k"], "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fill = {f: blank(f) & ~blank(f"_i_{f}") for f in fields}
    notes = F.map_from_entries(F.array_compact(F.array(*[F.when(fill[f], F.struct(F.lit(f), F.col("_tag"))) for f in fields])))
    old = F.coalesce(provenance, F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(notes), k)), notes)
    return j.select(*[F.when(fill[c], F.col(f"_i_{c}")).otherwise(F.col(c)).alias(c) if c in fields else merged.alias(c) if c == provenance else F.col(c) for c in stored.columns])
