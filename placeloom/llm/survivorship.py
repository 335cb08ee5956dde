"""Best representative of each duplicate group, chosen field by field.

Fields are unpivoted to long rows, each row votes for its normalised value with its source's
trust times a recency decay, and winners are picked with ``max_by``; :func:`golden_records`
pivots the winners back to one record per group. Every step is an aggregate with map-side
combine over (group, field, value), so a group of any size never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small

# Words that stand where a name, a city or an address should be.
FILLERS = ["", "na", "none", "null", "nil", "unknown", "unnamed", "noname", "namemissing", "missing", "tbd", "tba", "test", "todo", "undefined", "notprovided", "notavailable", "notgiven", "notset", "untitled", "placeholder", "default", "dummy", "xxx", "asdf"]
NAME_FILLERS = ["name", "venue", "venuename", "restaurant", "restaurantname", "business", "diner", "cafe", "place"]
CITY_FILLERS = ["city", "cityname", "town", "location", "address", "cityunknown", "unknowncity", "nocity"]
# File names that stand in for a photo.
STAND_IN = r"(?i)(^|[/_.-])(blank|placeholder|coming[-_]?soon|no[-_]?(image|photo|picture|pic)|(image|photo|picture)[-_]?(not[-_]?(available|found)|unavailable|missing)|default([-_][a-z]+)?|missing|spacer|pixel|1x1|empty|dummy|sample)(\.[a-z]{2,5})?$"


def squeezed(c: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def usable_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}") & ~squeezed(c).isin(FILLERS + NAME_FILLERS), F.lit(False))


def usable_city(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}") & ~squeezed(c).isin(FILLERS + CITY_FILLERS), F.lit(False))


def usable_photo(c: Column) -> Column:
    path = F.regexp_extract(F.trim(c), r"(?i)^https?://[^/?#\s]+(/[^?#\s]*)", 1)
    return F.coalesce((F.length(path) > 1) & ~F.regexp_extract(path, r"([^/]*)/?$", 1).rlike(STAND_IN), F.lit(False))


USABLE = {"name": usable_name, "city": usable_city, "photo_url": usable_photo}


def field_votes(rows: DataFrame, trust: DataFrame, fields: Sequence[str] = tuple(USABLE), half_life_days: float = 90.0, as_of: str | None = None) -> DataFrame:
    """(group_id, field, norm_value, votes, best): one row per value that competes.

    ``votes`` sums trust times decay over distinct records, where trust is 1 / (1 + trust_rank)
    and 0.05 for sources that ``trust`` lacks, and decay halves each ``half_life_days`` before
    ``as_of`` (1 from there on, 0.5 where ``updated_at`` is null), by default the latest ``updated_at``
    of all rows. ``best`` is the value's most trusted record.
    Rows without ``group_id`` or ``id`` belong to no group and are left out; repeated rows vote once.
    """
    known = trust.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("_s")).agg(F.min("trust_rank").alias("_rank"))
    at = F.unix_micros(F.col("updated_at").cast("timestamp"))
    now = rows.agg((F.max(at) if as_of is None else F.unix_micros(F.lit(as_of).cast("timestamp"))).alias("_now"))
    src = rows.where("group_id IS NOT NULL AND id IS NOT NULL").select("group_id", "id", F.lower(F.trim("source")).alias("_s"), "updated_at", *fields)
    ranked = src.join(broadcast_if_small(known), "_s", "left").crossJoin(F.broadcast(now))
    long = ranked.select(
        "group_id", "id", "updated_at", "_rank", "_now",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), USABLE[f](F.col(f)).alias("ok")) for f in fields])).alias("x"),
    ).where("x.ok").select("group_id", "id", "updated_at", "_rank", "_now", "x.field", "x.value")
    # greatest skips nulls, so an undated row would count as new
    days = F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.col("_now") - at) / F.lit(86400e6)))
    vote = F.coalesce(1.0 / (1 + F.col("_rank")), F.lit(0.05)) * F.coalesce(F.pow(F.lit(0.5), days / half_life_days), F.lit(0.5))
    order = F.struct(F.coalesce(-F.col("_rank"), F.lit(-(1 << 62))).alias("trust"), F.col("updated_at").isNotNull().alias("dated"), F.col("updated_at").alias("at"), (-F.col("id")).alias("first"))
    # a record that stands twice votes once: its rows meet in the same (group, field, value, id)
    once = long.groupBy("group_id", "field", squeezed(F.col("value")).alias("norm_value"), "id").agg(F.max(F.struct(order.alias("key"), F.col("value"))).alias("best"), F.max(vote).alias("vote"))
    return once.groupBy("group_id", "field", "norm_value").agg(F.sum("vote").alias("votes"), F.max("best").alias("best"))


def survivors(rows: DataFrame, trust: DataFrame, fields: Sequence[str] = tuple(USABLE), policy: str = "trust", **kw) -> DataFrame:
    """(group_id, field, id, value, votes): the surviving value of each group and field.

    Policy ``votes`` takes the value with the most votes. Policy ``trust`` takes the value of the
    smallest trust rank, then the latest ``updated_at`` (null last), then the smallest id, and
    votes only say how much support the winner has. Ties of votes, equal to nine digits, go by the trust order.
    A group or field with no usable value has no row.
    """
    v = field_votes(rows, trust, fields, **kw)
    rank = F.col("best.key") if policy == "trust" else F.struct(F.round(F.log("votes"), 9).alias("v"), F.col("best.key").alias("k"))
    won = v.groupBy("group_id", "field").agg(F.max_by(F.struct("best", "votes"), rank).alias("w"))
    return won.select("group_id", "field", (-F.col("w.best.key.first")).alias("id"), F.col("w.best.value").alias("value"), F.col("w.votes").alias("votes"))


def golden_records(rows: DataFrame, trust: DataFrame, fields: Sequence[str] = tuple(USABLE), policy: str = "votes", **kw) -> DataFrame:
    """One row per group: the winner of each field, pivoted back; null where nothing is usable."""
    s = survivors(rows, trust, fields, policy, **kw)
    won = s.groupBy("group_id").pivot("field", list(fields)).agg(F.first("value"))
    return rows.where("group_id IS NOT NULL").select("group_id").distinct().join(won, "group_id", "left")
