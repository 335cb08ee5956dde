"""Record matching, ordered greedy dedup and field merges between venue sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.text import last_ten_digits


def common_bytes(a: bytes, b: bytes) -> int:
    """Bytes in the longest common run, plus those left and right of it, found again and again.

    Of several longest runs the first in ``a``, then in ``b``, is taken, so the order of arguments matters.
    """
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        size = at_x = at_y = 0
        row = [0] * (len(y) + 1)
        runs = {}
        for i, c in enumerate(x, 1):
            new = [0] * (len(y) + 1)
            for j, d in enumerate(y, 1):
                if c == d:
                    new[j] = row[j - 1] + 1
                    if new[j] >= size:
                        runs.setdefault(new[j], []).append((i - new[j], j - new[j]))
                        size = max(size, new[j])
            row = new
        if size:
            at_x, at_y = min(runs[size])
            total += size
            todo += [(x[:at_x], y[:at_y]), (x[at_x + size :], y[at_y + size :])]
    return total


def likeness_percent(a: str | None, b: str | None) -> float | None:
    """200 x common bytes / bytes of both; null if either is null, 0 for two empty strings."""
    if a is None or b is None:
        return None
    x, y = a.encode(), b.encode()
    return 200.0 * common_bytes(x, y) / (len(x) + len(y)) if x or y else 0.0


def likeness(a: Column, b: Column) -> Column:
    """Column form of :func:`likeness_percent`, Arrow batches with a memo; use it on survivors of a join only."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict = {}
        for x, y in batches:
            out = []
            for p in zip(x.astype(object).where(x.notna(), None), y.astype(object).where(y.notna(), None)):
                if p not in memo:
                    memo[p] = likeness_percent(*p)
                out.append(memo[p])
            yield pd.Series(out, dtype="float64")

    return run(a, b)


def grid_pairs(left: DataFrame, right: DataFrame, km: float, size: float = 0.005, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides (columns lat, lng; other names must differ) within ``km``, with ``km``; of those, where there are ``keys`` (columns of both), the rows equal in them.

    Cells are probed three by three; in longitude as many as the latitude needs. The right side is replicated.
    Rows without known coordinates match nothing.
    """
    import math

    rows = math.ceil(km / 110.5 / size)
    l = left.where(geo.known(F.col("lat"), F.col("lng"))).withColumn("_cy", F.floor(F.col("lat") / size)).withColumn("_cx", F.floor(F.col("lng") / size))
    r = right.where(geo.known(F.col("lat"), F.col("lng"))).withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"})
    wide = F.ceil(km / (110.5 * F.cos(F.radians(F.least(F.lit(89.0), F.abs("r_lat") + size * rows)))) / size).cast("int")
    r = r.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("r_lat") / size) - rows, F.floor(F.col("r_lat") / size) + rows)))
    r = r.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("r_lng") / size) - wide, F.floor(F.col("r_lng") / size) + wide)))
    return l.join(r, ["_cy", "_cx", *keys]).withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).where(F.col("km") <= km).drop("_cy", "_cx")


def same_venue_edges(rows: DataFrame, km: float = 0.2, percent: float = 85.0) -> DataFrame:
    """(a, b), a before b in ``ord``: rows (ord, name, phone, lat, lng) that denote one venue.

    Same last ten digits of the phone, or names alike to ``percent``, both within ``km``. A bound on the lengths cuts
    pairs that cannot reach the percentage before any is compared.
    """
    r = rows.select("ord", F.lower(F.trim("name")).alias("n"), last_ten_digits(F.col("phone")).alias("p"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    b = r.select(F.col("ord").alias("ord_b"), F.col("n").alias("n_b"), F.col("p").alias("p_b"), "lat", "lng")
    near = grid_pairs(r, b, km).where("ord < ord_b")
    short, long = F.least(F.octet_length("n"), F.octet_length("n_b")), F.octet_length("n") + F.octet_length("n_b")
    phone = F.coalesce(F.col("p") == F.col("p_b"), F.lit(False))
    maybe = near.where(phone | ((F.col("n") != "") & (F.col("n_b") != "") & (200.0 * short / long >= percent)))
    sure = phone | F.coalesce(F.col("n") == F.col("n_b"), F.lit(False))
    return maybe.where(sure).select(F.col("ord").alias("a"), F.col("ord_b").alias("b")).unionByName(
        maybe.where(~sure).where(likeness(F.col("n"), F.col("n_b")) >= percent).select(F.col("ord").alias("a"), F.col("ord_b").alias("b")))


def greedy_anchors(rows: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(ord, anchor): each row with the anchor it folds into, its own ``ord`` for anchors.

    In order, a row is an anchor iff no earlier anchor matches it; it folds into the first that does, and nothing chains.
    Rounds settle all rows at once whose earlier neighbours are settled; they end after the longest run of
    dependent rows and never gather a component in one task.
    """
    from placeloom.session import discard, materialize

    spark = rows.sparkSession
    e, edge_path = materialize(edges.distinct(), "edges")
    state, path = materialize(rows.select("ord", F.lit(None).cast("long").alias("anchor")), "anchors")
    for _ in range(max_rounds):
        known = state.select(F.col("ord").alias("a"), F.col("anchor").alias("a_anchor"))
        seen = e.join(known, "a").groupBy(F.col("b").alias("ord")).agg(F.min(F.when(F.col("a_anchor") == F.col("a"), F.col("a"))).alias("first"), F.min(F.when(F.col("a_anchor").isNull(), F.col("a"))).alias("open"))
        j = state.join(seen, "ord", "left")
        # a row is settled once no undecided earlier neighbour stands before its first anchor
        settled = F.when(F.col("anchor").isNotNull(), F.col("anchor")).when(F.col("open").isNull() & F.col("first").isNull(), F.col("ord")).when(F.col("first") < F.coalesce("open", F.lit((1 << 63) - 1)), F.col("first"))
        new, new_path = materialize(j.select("ord", settled.alias("anchor")), "anchors")
        discard(spark, path)
        state, path = new, new_path
        if not state.where("anchor IS NULL").limit(1).count():
            discard(spark, edge_path)
            return state
    raise RuntimeError("chains of dependent rows are longer than max_rounds")


def merged(rows: DataFrame, group: str, order: str, fields: Sequence[str], pairs: Sequence[tuple[str, str]] = (), lists: Sequence[str] = ()) -> DataFrame:
    """One row per ``group``: for each field the first value in ``order`` that is not blank (null or ''; 0 is a value).

    A rating of ``pairs`` moves with its count, from the first row whose rating is not empty or zero; without one the
    first non-null count stays. ``lists`` are united without repeats, in order of the rows.
    """
    def first(c: str, ok: Column) -> Column:
        return F.min_by(F.col(c), F.when(ok, F.col(order))).alias(c)

    types = dict(rows.dtypes)
    aggs = [first(f, F.col(f).isNotNull() & ((F.col(f) != "") if types[f] == "string" else F.lit(True))) for f in fields]
    for rating, count in pairs:
        aggs += [F.min_by(F.struct(rating, count), F.when(F.col(rating) > 0, F.col(order))).alias(f"_{rating}"), F.min_by(F.col(count), F.when(F.col(count).isNotNull(), F.col(order))).alias(f"_{count}")]
    for c in lists:
        aggs.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda s: s["v"]))).alias(c))
    out = rows.groupBy(group).agg(*aggs)
    for rating, count in pairs:
        out = out.withColumn(rating, F.col(f"_{rating}.{rating}")).withColumn(count, F.coalesce(f"_{rating}.{count}", f"_{count}"))
    return out.select(group, *fields, *[c for p in pairs for c in p], *lists)


def nearest_match(venues: DataFrame, places: DataFrame, km: float = 0.2, percent: float = 85.0) -> DataFrame:
    """(id, place_id, by_phone, km): for each venue the best place of the same venue.

    venues: id, name, phone, lat, lng; places: place_id, place_name, place_phones (last ten digits), lat, lng. A common
    phone goes before a like name, then the smaller sum of coordinate differences, then the smaller place id. Where only
    equal names count, rows meet by name or phone within their cells, not all with all; of places that equal each other
    in all that is asked, the smallest id stands for the others.
    """
    v = venues.select("id", F.lower(F.trim("name")).alias("n"), last_ten_digits(F.col("phone")).alias("p"), "lat", "lng")
    q = places.withColumn("pn", F.lower(F.trim("place_name")))
    if percent >= 100:
        q = q.groupBy("pn", "place_phones", "lat", "lng").agg(F.min("place_id").alias("place_id"))
        names = lambda c: F.when(F.col(c) != "", F.array(F.concat(F.lit("n"), c))).otherwise(F.array().cast("array<string>"))
        phones = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("p"), x))
        keyed = lambda df, name, tails: df.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.concat(names(name), phones(tails))))))
        c = grid_pairs(keyed(v, "n", F.array("p")), keyed(q, "pn", F.col("place_phones")), km, keys=["_key"])
    else:
        c = grid_pairs(v, q, km)
    phone = F.coalesce(F.array_contains("place_phones", F.col("p")), F.lit(False))
    short, long = F.least(F.octet_length("n"), F.octet_length("pn")), F.octet_length("n") + F.octet_length("pn")
    c = c.withColumn("by_phone", phone).where(phone | ((F.col("n") != "") & (F.col("pn") != "") & (200.0 * short / long >= percent)))
    c = c.withColumn("_l1", F.abs(F.col("lat") - F.col("r_lat")) + F.abs(F.col("lng") - F.col("r_lng")))
    if percent >= 100:
        c = c.where(F.col("by_phone") | (F.col("n") == F.col("pn")))
    else:
        c = c.where(F.col("by_phone") | (F.when(~F.col("by_phone") & (F.col("n") != F.col("pn")), likeness(F.col("n"), F.col("pn"))).otherwise(F.lit(100.0)) >= percent))
    best = F.struct((~F.col("by_phone")).alias("late"), F.col("_l1"), F.col("place_id"))
    return c.groupBy("id").agg(F.min_by(F.struct("place_id", "by_phone", "km"), best).alias("b")).select("id", "b.*")
