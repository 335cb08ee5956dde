"""Data-quality detectors: each takes rows and gives findings (id, field, reason, detail); and the reversible overlay of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.session import broadcast_if_small
from placeloom.sources.gazetteers import area_states

FINDING = ["id", "field", "reason", "detail"]


def findings(df: DataFrame, field: str, reason: str, detail: Column) -> DataFrame:
    return df.select("id", F.lit(field).alias("field"), F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))


def rating_clusters(r: DataFrame) -> DataFrame:
    """Active rows whose (name, rating, count) stands in two or more cities, with their key, phone, state and area's home."""
    key = ["nk", "google_rating", "google_review_count"]
    rows = r.where("is_active AND google_rating > 0").select("id", text.name_key(F.col("name")).alias("nk"), "google_rating", "google_review_count", F.lower(F.trim("city")).alias("city"), text.last_ten_digits(F.col("phone")).alias("p"), text.state_code(F.col("state")).alias("st"))
    many = rows.groupBy(*key).agg(F.countDistinct("city").alias("cities")).where("cities > 1").select(*[F.col(k).alias(f"_{k}") for k in key])
    return rows.join(many, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).drop(*[f"_{k}" for k in key])


def copied_ratings(r: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One (name, rating, count) in two or more cities: all rows but the owner's; ``detail`` is the owner's id, null without one.

    The owner is the one row in the area code's state among several that share a phone (the smallest such phone decides),
    else the one row of the cluster whose own phone is local to its state. ``areas`` (area, home) defaults to what the rows teach.
    """
    key = ["nk", "google_rating", "google_review_count"]
    home = area_states(r) if areas is None else areas
    rows = rating_clusters(r).join(home, F.left("p", F.lit(3)) == F.col("area"), "left").withColumn("local", F.coalesce(F.col("home") == F.col("st"), F.lit(False)))
    shared = rows.where("p IS NOT NULL").groupBy(*key, "p").agg(F.count("*").alias("n"), F.count_if("local").alias("here"), F.min(F.when(F.col("local"), F.col("id"))).alias("id")).where("n > 1 AND here = 1")
    first = shared.groupBy(*key).agg(F.min_by("id", "p").alias("by_phone"))
    alone = rows.groupBy(*key).agg(F.count_if("local").alias("here"), F.min(F.when(F.col("local"), F.col("id"))).alias("id"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    owners = alone.alias("a").join(first.alias("f"), same("a", "f"), "left").select(*[F.col(f"a.{k}").alias(k) for k in key], F.coalesce("f.by_phone", F.when(F.col("a.here") == 1, F.col("a.id"))).alias("owner"))
    bad = rows.alias("r").join(owners.alias("o"), same("r", "o")).where(F.col("owner").isNull() | (F.col("r.id") != F.col("owner"))).select("r.id", "owner")
    return findings(bad, "google_rating", "copied rating", F.col("owner"))


def copied_phones(r: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One (name, phone) in two or more cities: active rows whose state is not the area code's, null counting as another.

    Area codes without a known state say nothing. ``areas`` (area, home) defaults to what the rows teach.
    """
    home = area_states(r) if areas is None else areas
    rows = r.where("is_active").select("id", text.name_key(F.col("name")).alias("nk"), text.last_ten_digits(F.col("phone")).alias("p"), F.lower(F.trim("city")).alias("city"), text.state_code(F.col("state")).alias("st")).where("p IS NOT NULL")
    many = rows.groupBy("nk", "p").agg(F.countDistinct("city").alias("cities")).where("cities > 1")
    bad = rows.join(many, ["nk", "p"]).withColumn("area", F.left("p", F.lit(3))).join(home, "area").where("st IS NULL OR st <> home")
    return findings(bad, "phone", "copied phone", F.col("home"))


def foreign_state_addresses(r: DataFrame, zips: DataFrame | None = None, km: float = 50.0) -> DataFrame:
    """Addresses that end in another state than the row's, unless the address's own ZIP lies within ``km`` of the pin."""
    named = text.city_state_of(F.col("address"))["state"]
    rows = r.withColumn("named", named).withColumn("own", text.state_code(F.col("state"))).where("named <> own")
    if zips is not None:
        z = broadcast_if_small(zips.select(F.col("zip").alias("_z"), F.col("lat").alias("z_lat"), F.col("lng").alias("z_lng")))
        away = geo.haversine_asin_km(F.col("z_lat"), F.col("z_lng"), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
        near = F.coalesce(geo.known(F.col("latitude"), F.col("longitude")) & (away <= km), F.lit(False))
        rows = rows.withColumn("_zip", text.zip_of(F.col("address"), F.lit(None).cast("string"))).join(z, F.col("_zip") == F.col("_z"), "left").where(~near)
    return findings(rows, "address", "names another state", F.col("named"))


def far_zips(r: DataFrame, zips: DataFrame, km: float = 50.0) -> DataFrame:
    """ZIPs (of the address, else the postal code) whose centroid is farther from the pin than ``km`` and three radii."""
    z = broadcast_if_small(zips.select(F.col("zip").alias("_z"), F.col("lat").alias("z_lat"), F.col("lng").alias("z_lng"), "radius_km"))
    rows = r.where(geo.known(F.col("latitude"), F.col("longitude"))).withColumn("_zip", text.zip_of(F.col("address"), F.col("postal_code")))
    far = geo.haversine_asin_km(F.col("z_lat"), F.col("z_lng"), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    return findings(rows.join(z, F.col("_zip") == F.col("_z")).where(far > F.greatest(F.lit(km), 3 * F.coalesce("radius_km", F.lit(0.0)))), "postal_code", "far from pin", F.col("_zip"))


def blocked_websites(r: DataFrame, hosts: list[str]) -> DataFrame:
    """Websites on a host, or a subdomain of one, that is no venue's own."""
    h = text.url_host(F.col("website_url"))
    hit = h.isin(hosts)
    for x in hosts:
        hit = hit | h.endswith("." + x)
    return findings(r.where(hit), "website_url", "blocked host", h)


def normalized(r: DataFrame) -> DataFrame:
    """Fields in one form: single spaces, state codes, ten-digit phones, ratings in 0..5, coordinates on the globe, names cut at 255."""
    lim = lambda c, a, b: F.when(F.col(c).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(c).cast("double"))))
    return r.select(
        "id", F.left(text.collapsed(F.col("name")), F.lit(255)).alias("name"), text.collapsed(F.col("city")).alias("city"), F.coalesce(text.state_code(F.col("state")), F.trim("state")).alias("state"), text.last_ten_digits(F.col("phone")).alias("phone"),
        F.round(lim("google_rating", 0.0, 5.0), 1).alias("google_rating"), lim("latitude", -90.0, 90.0).alias("latitude"), lim("longitude", -180.0, 180.0).alias("longitude"), F.greatest(F.lit(0), F.col("google_review_count")).alias("google_review_count"))


def tidied(r: DataFrame) -> DataFrame:
    """(id, name, address, city, state, phone, changed): fields in one form and, where blank, read from the address.

    City: title case with small words, else the address's; state: its code, else the address's; name and address: single
    spaces; phone: its last ten digits. ``changed`` lists the fields that differ from the row's, in that order.
    """
    parts = text.city_state_of(F.col("address"))
    none = lambda c: F.when(c != "", c)
    new = {
        "name": F.coalesce(none(text.collapsed(F.col("name"))), F.col("name")), "address": none(text.collapsed(F.col("address"))),
        "city": text.title_case(F.when(~text.blank(F.col("city")), F.col("city")).otherwise(parts["city"])), "state": F.when(~text.blank(F.col("state")), F.coalesce(text.state_code(F.col("state")), F.trim("state"))).otherwise(parts["state"]), "phone": text.last_ten_digits(F.col("phone")),
    }
    made = r.select("id", *[F.col(f).alias(f"_{f}") for f in new], *[c.alias(f) for f, c in new.items()])
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in new]))
    return made.select("id", *new, F.array_join(changed, ",").alias("changed"))


def schedule_problems(fires: DataFrame, registered: DataFrame, start: str, end: str, tolerance_minutes: int = 10) -> DataFrame:
    """(command, never_fired, failed, hung, off_schedule, off_schedule_fires, stopped_firing, over_fired) per registered command.

    ``fires``: command, at, status ('done', 'failed' or null while running). ``registered``: command, every_minutes,
    offset_minutes, budget_minutes. Slots stand every ``every_minutes`` after midnight plus the offset. A fire is off schedule
    where it is farther than the tolerance from its nearest slot; off_schedule speaks of the last fire, off_schedule_fires counts
    all. stopped_firing: the last fire is older than one and a half periods; over_fired: more fires than slots; never_fired: slots but no
    fire; hung: a start without end whose budget has passed.
    """
    minute = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(60e6)
    a, z = minute(F.lit(start)), minute(F.lit(end))
    f = fires.where((F.col("at") >= F.lit(start).cast("timestamp")) & (F.col("at") <= F.lit(end).cast("timestamp"))).join(broadcast_if_small(registered), "command")
    behind = F.pmod(minute(F.col("at")) - F.col("offset_minutes"), F.col("every_minutes").cast("double"))
    drift = F.least(behind, F.col("every_minutes") - behind)
    per = f.groupBy("command").agg(F.count("*").alias("fires"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull() & (z - minute(F.col("at")) > F.col("budget_minutes"))).alias("hung"), F.max_by(drift, F.col("at")).alias("last_drift"), F.count_if(drift > tolerance_minutes).alias("off"), F.max(minute(F.col("at"))).alias("last"))
    slots = F.floor((z - F.col("offset_minutes")) / F.col("every_minutes")) - F.floor((a - F.col("offset_minutes") - 1e-9) / F.col("every_minutes"))
    j = registered.join(per, "command", "left").withColumn("slots", slots).withColumn("n", F.coalesce("fires", F.lit(0)))
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("command", ((F.col("n") == 0) & (F.col("slots") > 0)).alias("never_fired"), no(F.col("failed") > 0).alias("failed"), no(F.col("hung") > 0).alias("hung"), no(F.col("last_drift") > tolerance_minutes).alias("off_schedule"), F.coalesce("off", F.lit(0)).alias("off_schedule_fires"),
                    no(z - F.col("last") > 1.5 * F.col("every_minutes")).alias("stopped_firing"), (F.col("n") > F.col("slots")).alias("over_fired"))


#: Detectors by name; add to it to extend a run.
DETECTORS: dict[str, Callable[..., DataFrame]] = {"copied_ratings": copied_ratings, "copied_phones": copied_phones, "foreign_state_addresses": foreign_state_addresses}


def detect(r: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of several detectors, with the detector's name."""
    out = None
    for n in names or list(DETECTORS):
        f = DETECTORS[n](r).withColumn("detector", F.lit(n))
        out = f if out is None else out.unionByName(f)
    return out


def quarantine(r: DataFrame, found: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current view, log): found values are cleared in the view and kept in the log, so they can be restored.

    Several findings on one value make one log entry.
    """
    f = found.where(F.col("field").isin(fields)).groupBy("id", "field").agg(F.min("reason").alias("reason"))
    flags = f.groupBy("id").agg(F.collect_set("field").alias("_bad"))
    j = r.join(flags, "id", "left")
    bad = lambda c: F.coalesce(F.array_contains("_bad", c), F.lit(False))
    view = j.select(*[F.when(~bad(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in r.columns])
    old = r.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value")) for c in fields])).alias("x")).select("id", "x.*")
    return view, f.join(old, ["id", "field"])


def restored(view: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """The view with logged values put back where the field is still empty."""
    back = log.groupBy("id").pivot("field", fields).agg(F.first("old_value"))
    b = back.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_o_{c}") for c in fields])
    j = view.join(b, view["id"] == b["_id"], "left")
    types = dict(view.dtypes)
    return j.select(*[F.coalesce(c, F.col(f"_o_{c}").cast(types[c])).alias(c) if c in fields else F.col(c) for c in view.columns])
