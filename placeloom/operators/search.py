"""Search results: sort modes, pages of a stored snapshot, and the merge of stored and live rows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.integration import nearby_alike
from placeloom.operators.relational import ranked
from placeloom.operators.scoring import decayed
from placeloom.session import shared_dir


def sort_order(mode: str, as_of: str, distance: Column | None = None) -> list[Column]:
    """The order of a result set: best_match, nearest, rating or reviews; unknown modes, and nearest without a position, are best_match.

    Rows of equal rank, and all of best_match, go by the decayed score and then by the id.
    """
    best = [F.round(decayed(F.col("popularity_score"), F.col("updated_at"), as_of), 9).desc_nulls_last(), F.col("id").asc()]
    rating = F.col("google_rating").cast("double")
    if mode == "nearest" and distance is not None:
        return [F.round(distance, 6).asc_nulls_last(), F.col("id").asc()]
    if mode == "rating":  # few reviews carry little credit
        return [F.when(F.col("google_review_count") < 20, rating - 10).otherwise(rating).desc_nulls_last(), *best]
    if mode == "reviews":
        return [F.coalesce("google_review_count", "yelp_review_count").desc_nulls_last(), *best]
    return best


def store_snapshot(rows: DataFrame, key: str, order: Sequence[Column], hours: int = 24) -> str:
    """Rank ``rows`` once and store (key, id, position, total, expires_at) in the shared folder; returns its path."""
    spark = rows.sparkSession
    at = ranked(rows, "position", *order).select("id", "position")
    whole = at.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    whole.select(F.lit(key).alias("key"), "id", "position", "total", (F.current_timestamp() + F.make_interval(hours=F.lit(hours))).alias("expires_at")).write.parquet(path)
    return path


def snapshot_page(spark: SparkSession, path: str, key: str, page: int, size: int) -> DataFrame:
    """(id, position, total, last_page, from, to) of one page of an unexpired snapshot; later pages do not rank again."""
    s = spark.read.parquet(path).where((F.col("key") == key) & (F.col("expires_at") > F.current_timestamp()))
    first = (page - 1) * size
    rows = s.where((F.col("position") > first) & (F.col("position") <= first + size))
    return rows.select("id", "position", "total", F.ceil(F.col("total") / size).cast("long").alias("last_page"), F.lit(first + 1).cast("long").alias("from"), F.least(F.col("total"), F.lit(first + size)).cast("long").alias("to"))


def same_venue_matches(live: DataFrame, stored: DataFrame, keys: Sequence[str], km: float = 0.2, percent: float = 85.0) -> DataFrame:
    """(live_id, stored_id): for each live row the first stored row (by id) that any rule matches: an equal key or a near, alike name.

    Both sides have n, lat, lng and the keys; blank keys match nothing.
    """
    some = lambda df, k: df.where(F.col(k).isNotNull() & (F.col(k) != ""))
    hits = nearby_alike(live, stored, km, percent)
    for k in keys:
        first = some(stored, k).groupBy(k).agg(F.min("stored_id").alias("stored_id"))
        hits = hits.unionByName(some(live, k).select("live_id", k).join(first, k).select("live_id", "stored_id"))
    return hits.groupBy("live_id").agg(F.min("stored_id").alias("stored_id"))


def search_merge(stored: DataFrame, live: DataFrame, closed: DataFrame, keys: Sequence[str], overlay: Sequence[str], **rule) -> DataFrame:
    """Stored rows with the live rows that fold into them, and the live rows that are new: (id, live_ids, persist, *overlay).

    A live row folds into at most one stored row; a stored row may take several, in the order of their ids, and a later
    value that is not blank replaces an earlier one. Live rows that match no stored but a closed row are dropped, others are
    to be persisted. live_ids counts what was folded in.
    """
    match = same_venue_matches(live, stored, keys, **rule)
    shut = same_venue_matches(live, closed, keys, **rule).select("live_id")
    kinds = dict(live.dtypes)
    said = lambda f: F.col(f).isNotNull() & ((F.trim(f) != "") if kinds[f] == "string" else (F.col(f) > 0))
    folded = live.join(match, "live_id").groupBy("stored_id").agg(F.count("*").alias("live_ids"), *[F.max_by(f, F.when(said(f), F.col("live_id"))).alias(f"_{f}") for f in overlay])
    base = stored.join(folded, "stored_id", "left").select(F.col("stored_id").alias("id"), F.coalesce("live_ids", F.lit(0)).alias("live_ids"), F.lit(False).alias("persist"), *[F.coalesce(f"_{f}", f).alias(f) for f in overlay])
    new = live.join(match, "live_id", "left_anti").join(shut, "live_id", "left_anti").select(F.col("live_id").alias("id"), F.lit(0).cast("long").alias("live_ids"), F.lit(True).alias("persist"), *overlay)
    return base.unionByName(new)


def field_policy(stored: DataFrame, incoming: DataFrame, quarantined: DataFrame, far: Mapping[str, Column]) -> DataFrame:
    """``stored`` (id, address, postal_code, phone, photo_url, google_rating, google_review_count) after one incoming row each.

    ``incoming``: the same columns. Blank values never overwrite and others only fill blanks; a rating above zero
    replaces with its count, unless just that pair is quarantined; a quarantined value is never filled in again; an address or
    postal code that ``far`` (conditions on the incoming columns i_*) calls far from the pin is refused; a photo of the
    decaying kind gives way to one that is not. ``quarantined``: (id, field, old_value).
    """
    fill = ["address", "postal_code", "phone", "photo_url"]
    i = incoming.select(F.col("id").alias("_i"), *[F.col(c).alias(f"i_{c}") for c in [*fill, "google_rating", "google_review_count"]])
    q = quarantined.groupBy(F.col("id").alias("_q")).agg(F.collect_set(F.concat_ws("=", "field", "old_value")).alias("_bad"))
    j = stored.join(i, stored["id"] == i["_i"], "left").join(q, stored["id"] == q["_q"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    bad = lambda f, v: yes(F.array_contains("_bad", F.concat(F.lit(f + "="), v)))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fades = lambda c: yes(F.lower(c).contains("gps-cs-s"))
    rating, count = F.col("i_google_rating").cast("double"), F.greatest(F.lit(0), F.coalesce("i_google_review_count", F.lit(0)))
    rated = yes(rating > 0) & ~(bad("google_rating", rating.cast("string")) & bad("google_review_count", count.cast("string")))
    out = []
    for f in fill:
        ok = ~blank(f"i_{f}") & ~bad(f, F.col(f"i_{f}")) & ~yes(far.get(f, F.lit(False)))
        take = blank(f) | (fades(F.col(f)) & ~fades(F.col(f"i_{f}")) if f == "photo_url" else F.lit(False))
        out.append(F.when(ok & take, F.col(f"i_{f}")).otherwise(F.col(f)).alias(f))
    return j.select("id", *out, F.when(rated, rating).otherwise(F.col("google_rating").cast("double")).alias("google_rating"), F.when(rated, count).otherwise(F.col("google_review_count")).alias("google_review_count"))


def chained_merges(*passes: DataFrame) -> DataFrame:
    """(dupe, keep, pass) of passes (dupe, keep) in which a row that went in an earlier pass takes no part: the last keeper of each chain."""
    out = None
    for n, p in enumerate(passes, 1):
        p = p.select("dupe", "keep", F.lit(n).alias("pass"))
        if out is not None:
            later = p.select(F.col("dupe").alias("_d"), F.col("keep").alias("_k"))
            out = out.join(later, out["keep"] == later["_d"], "left").select("dupe", F.coalesce("_k", "keep").alias("keep"), "pass")
        out = p if out is None else out.unionByName(p)
    return out


def merged_pairs(rows: DataFrame, mapping: DataFrame, fill: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """(id, *fill, *counters): kept rows with blanks filled from their duplicates in order of id, and counters summed."""
    kinds = dict(rows.dtypes)
    j = rows.join(mapping.select(F.col("dupe").alias("id"), "keep"), "id", "left").withColumn("_keep", F.coalesce("keep", "id"))
    said = lambda f: F.col(f).isNotNull() & ((F.col(f) != "") if kinds[f] == "string" else (F.col(f) != 0))
    # the kept row stands first, whatever the order of ids
    at = F.struct((F.col("id") != F.col("_keep")).alias("late"), F.col("id"))
    own = lambda f: F.min_by(f, at)
    return j.groupBy(F.col("_keep").alias("id")).agg(*[F.coalesce(F.min_by(f, F.when(said(f), at)), own(f)).alias(f) for f in fill], *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in counters])


def repointed(child: DataFrame, mapping: DataFrame, ref: str, unique: Sequence[str] | None = None) -> DataFrame:
    """Child rows with ``ref`` set to the kept row; of rows that then agree in ``unique`` one stays (all distinct rows where None)."""
    m = mapping.select(F.col("dupe").alias("_d"), F.col("keep").alias("_k"))
    j = child.join(m, child[ref] == m["_d"], "left").withColumn(ref, F.coalesce("_k", ref)).drop("_d", "_k")
    return j.dropDuplicates(list(unique)) if unique else j.distinct()
