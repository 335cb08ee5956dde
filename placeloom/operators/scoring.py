"""Collection-aware scores: denominators and means of a collection in one pass, then Columns only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.geo import known

# The default weight of each signal, in the order they are listed in a breakdown.
WEIGHTS = {
    "quality": 0.35, "evidence": 0.35, "proximity": 0.15, "data_completeness": 0.05, "has_award": 0.05, "cuisine_match": 0.50,
    "website_clicks_count": 0.20, "pageviews_count": 0.10, "social_link_clicks_count": 0.05, "menu_click_count": 0.05, "directions_clicks_count": 0.05, "call_clicks_count": 0.05,
}
COUNTS = ["website_clicks_count", "pageviews_count", "social_link_clicks_count", "menu_click_count", "directions_clicks_count", "call_clicks_count"]
COMPLETENESS = ["name", "address", "phone", "latitude", "longitude", "price_range", "website_url", "photo_url", "features", "social_links_count"]


@dataclass(frozen=True)
class ScoringConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    prior_reviews: int = 50
    mean_fallback: float = 4.0
    proximity_km: float = 2.0
    log_floor: int = 500
    log_default: int = 5000
    evidence_cap: float = 0.85


def col(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column if the table has it, else null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def filled(df: DataFrame, name: str) -> Column:
    """Numbers are filled unless 0, texts unless blank, lists unless empty."""
    if name not in df.columns:
        return F.lit(0)
    t = dict(df.dtypes)[name]
    ok = F.trim(name) != "" if t == "string" else F.size(name) > 0 if t.startswith("array") else F.col(name) != 0
    return F.coalesce(ok, F.lit(False)).cast("int")


def collection_stats(df: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """One row: the credible mean rating and, for each count, the denominator of its logarithm.

    The mean is over rated rows with enough reviews and known coordinates. A denominator is the largest positive count
    but at least the floor, and the default where no count is positive. An empty table gives the fallbacks.
    """
    rating, reviews = col(df, "google_rating").cast("double"), col(df, "google_review_count")
    ok = (rating > 0) & (reviews >= cfg.prior_reviews) & known(col(df, "latitude"), col(df, "longitude"))
    dens = [F.when(F.max(F.when(col(df, c) > 0, col(df, c))).isNull(), F.lit(float(cfg.log_default))).otherwise(F.greatest(F.max(F.when(col(df, c) > 0, col(df, c))).cast("double"), F.lit(float(cfg.log_floor)))).alias(f"den_{c}") for c in COUNTS]
    return df.agg(F.coalesce(F.avg(F.when(ok, rating)), F.lit(cfg.mean_fallback)).alias("mean_rating"), *dens)


def signals(df: DataFrame, cfg: ScoringConfig) -> list[tuple[str, Column, Column]]:
    """(name, active, value in 0..1) of each signal, over ``df`` joined with its collection's stats."""
    rating, reviews = col(df, "google_rating").cast("double"), F.coalesce(col(df, "google_review_count"), F.lit(0)).cast("double")
    m = float(cfg.prior_reviews)
    quality = clamp((reviews / (reviews + m) * rating + m / (reviews + m) * F.col("mean_rating")) / 5)
    rated = F.coalesce(rating > 0, F.lit(False))
    n = F.coalesce(col(df, "overture_sources", "int"), F.lit(0))
    site = F.coalesce(F.trim(col(df, "website_url", "string")) != "", F.lit(False))
    identity = col(df, "website_identity", "string")
    evidence = F.round(F.round(cfg.evidence_cap * (
        0.30 * F.when(n >= 3, 1.0).when(n == 2, 0.8).when(n == 1, 0.5).otherwise(0.0) + 0.20 * clamp(F.coalesce(col(df, "overture_confidence").cast("double"), F.lit(0.0)))
        + 0.20 * F.when(~site, 0.0).when(identity == "verified", 1.0).when(identity == "brand", 0.6).otherwise(0.3)
        + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0), F.coalesce(col(df, "social_links_count", "int"), F.lit(0))) / 3)
        + 0.15 * (F.coalesce(F.size(col(df, "features", "array<string>")), F.lit(0)) > 0).cast("double")), 12), 4)
    evidence = F.when(F.coalesce(col(df, "overture_status", "string") == "permanently_closed", F.lit(False)), 0.0).otherwise(evidence)
    far = col(df, "distance").cast("double")
    completeness = F.round(sum((filled(df, c) for c in COMPLETENESS), F.lit(0)) / len(COMPLETENESS), 4)
    match = col(df, "cuisine_match").cast("double")
    on = F.lit(True)
    out = [
        ("quality", rated, quality), ("evidence", ~rated, evidence), ("proximity", F.coalesce(far >= 0, F.lit(False)), clamp(1 / (1 + far / cfg.proximity_km))), ("data_completeness", on, completeness),
        ("has_award", F.coalesce(col(df, "has_award", "boolean"), F.lit(False)), F.lit(1.0)), ("cuisine_match", match.isNotNull(), clamp(match)),
    ]
    return out + [(c, on, clamp(F.log1p(F.coalesce(col(df, c), F.lit(0)).cast("double")) / F.log1p(F.col(f"den_{c}")))) for c in COUNTS]


def scored(df: DataFrame, stats: DataFrame, cfg: ScoringConfig = ScoringConfig(), breakdown: bool = False) -> DataFrame:
    """``df`` with ``score``: the weighted mean of its active signals, weights renormalised to the active set.

    ``stats`` says which collection the row is compared with (page, result set or corpus): it is one row, broadcast. With
    ``breakdown`` the active signals come along as structs, largest contribution first.
    """
    j = df.crossJoin(F.broadcast(stats))
    parts = [(s, cfg.weights.get(s, 0.0), a, v) for s, a, v in signals(j, cfg) if cfg.weights.get(s, 0.0) > 0]
    total = sum((F.when(a, w).otherwise(0.0) for _, w, a, _ in parts), F.lit(0.0))
    raw = sum((F.when(a, w * v).otherwise(0.0) for _, w, a, v in parts), F.lit(0.0))
    j = j.withColumn("score", F.when(total <= 0, 0.0).otherwise(F.coalesce(F.round(F.round(raw / total, 12), 4), F.lit(0.0))))  # the order of summation must not decide a half
    if breakdown:
        rows = F.array(*[F.when(a, F.struct((-F.round(w * v / total, 6)).alias("key"), F.lit(i).alias("i"), F.lit(s).alias("signal"), F.round(w / total, 6).alias("weight"), F.round(v, 6).alias("normalized"))) for i, (s, w, a, v) in enumerate(parts)])
        j = j.withColumn("breakdown", F.transform(F.array_sort(F.array_compact(rows)), lambda r: F.struct(r["signal"].alias("signal"), r["weight"].alias("weight"), r["normalized"].alias("normalized"), (-r["key"]).alias("contribution"))))
    return j.drop(*stats.columns)


def decayed(score: Column, updated: Column, as_of: str, days: float = 90, floor: float = 0.5) -> Column:
    """The score less its age: linear to nothing over ``days``, never under ``floor``; null without a date."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(86400e6)
    return F.when(updated.isNotNull(), score.cast("double") * F.greatest(F.lit(floor), 1.0 - age / days))
