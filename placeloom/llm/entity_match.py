"""Matching entities of two sources that share no key.

Records are blocked on their address (and, where one has none, on name and ZIP or phone), candidate
pairs become vectors of similarities, and a two-component Gaussian mixture separates matched from
unmatched vectors without labels. Components have diagonal covariances that are regularised in
proportion to the distance of their means, so a feature that is constant in one of them cannot blow
up. During expectation-maximisation the posteriors are made transitive: if a matches b and b
matches c, then a and c must match, or the weaker of the two links gives way.

Similarities are rounded to twentieths, so the driver fits the mixture on a histogram of vectors, whose
size does not depend on the number of pairs. Copies of a record are one profile while pairs are made
and are expanded again at the end. Missing attributes are left out of the likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.addresses import canonical, edits, fold, parsed, words_of
from placeloom.session import discard, materialize, tidy

# Words that say what sort of venue it is, legal forms, and stand-ins for names.
KINDS = (
    "bakery bar barbecue bistro brasserie brewery buffet burgers cafe cafeteria canteen cantina catering chophouse cocina coffee coffeehouse confectionery creamery creperie deli delicatessen diner drivein eatery gastropub grill grille "
    "hotel house inn izakaya joint kitchen lounge market noodle noodles osteria patisserie pizza pizzeria pub ramen restaurant ristorante roastery rotisserie saloon sandwiches shop smokehouse steakhouse sushi taproom taqueria tavern tearoom trattoria"
).split()
LEGAL = {"llc", "inc", "ltd", "co", "corp", "company", "the", "and", "a", "of", "at"}
NO_NAME = {"unnamed", "unknown", "na", "none", "null", "test", "tbd", "noname", "namemissing", "name", "venue", "business"}
FEATURES = ["name", "address", "postal", "phone", "place"]
STEPS = 20
RADIX = STEPS + 2
#: Share of values that say nothing about their record, by feature.
STRAY = [1e-4, 1e-3, 0.02, 0.02, 0.02]


@lru_cache(maxsize=50_000)
def kind_of(token: str) -> str:
    """The kind word that ``token`` is, misspells by one letter or abbreviates; else ''."""
    if token in KINDS:
        return token
    for k in KINDS:
        if len(token) >= 3 and token[0] == k[0] and len(token) < len(k):
            it = iter(k)
            if k.startswith(token) or (all(c in it for c in token) and token[-1] == k[-1] and len(token) >= 0.6 * len(k)):
                return k
        # short kinds differ from common words by one letter (horse, stone), so there only swapped letters count
        if len(k) >= 6 and len(token) >= 5 and edits(token, k, 1) <= 1 or len(k) >= 4 and token[0] == k[0] and sorted(token) == sorted(k):
            return k
    return ""


def name_parts(name: str | None, city: str = "") -> tuple[str, str]:
    """(core, kinds) of a name: its own words and its kind words, each sorted; core is '' for no name."""
    n = fold(name or "")
    n = re.sub(r"\([^)]*\)|#\s*\d+", " ", n)
    if re.match(r"\s*[$€£]?\s*\d+[.,]\d", n):
        return "", ""
    head, dash, tail = n.rpartition(" - ")
    if dash and head.strip():
        n = head
    n = re.sub(r"\bb\s*&\s*g\b", "bar grill", n)
    w = [x for x in words_of(n) if x not in LEGAL]
    if "".join(words_of(n)) in NO_NAME or not any(re.search("[a-z]", x) for x in w):
        return "", ""
    kinds = {x: kind_of(x) for x in w}
    core = sorted(x for x in w if not kinds[x])
    return " ".join(core), " ".join(sorted({k for k in kinds.values() if k and k != "restaurant"}))


@lru_cache(maxsize=50_000)
def token_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    most = 1 if min(len(a), len(b)) < 8 else 2
    if min(len(a), len(b)) < 3:
        return 0.0
    d = edits(a, b, most)
    return 1 - d / max(len(a), len(b)) if d <= most else 0.0


@lru_cache(maxsize=50_000)
def name_likeness(core_a: str, kinds_a: str, core_b: str, kinds_b: str) -> float:
    """Share of the letters in like words, lowered by a fifth when the kinds differ; -1 if a name is missing."""
    if not core_a or not core_b:
        return -1.0
    a, b = core_a.split(), core_b.split()
    left, same = list(b), 0.0
    for x in a:
        score, y = max(((token_likeness(x, y), y) for y in left), default=(0.0, ""))
        if score > 0:
            left.remove(y)
            same += score * (len(x) + len(y))
    core = same / sum(map(len, a + b))
    ka, kb = set(kinds_a.split()), set(kinds_b.split())
    return core * (0.8 if ka and kb and not ka & kb else 1.0)


def profile(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, members): distinct records without their ids, numbered, and the rows behind each, once.

    ``multi`` says of a member that its id stands behind several profiles.
    """
    spark = records.sparkSession
    # one Python pass reads address and name together
    parts, at = materialize(parsed(records, "rid", "address", "city_text", "state_text", "postal", "src", "phones", "lat", "lng", extra=("name", ["core", "kinds"], name_parts)), "records")
    stages = [at]
    full = canonical(parts, keep_unlocated=True, stages=stages)
    known = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & (F.abs("lat") + F.abs("lng") > 0.5) & (F.abs("lat") > 0.01) & (F.abs("lng") > 0.01)
    full = full.withColumn("lat", F.when(known, F.col("lat"))).withColumn("lng", F.when(known, F.col("lng")))
    spot = F.when(F.col("location").isNull(), F.concat_ws(",", F.round("lat", 3), F.round("lng", 3)))
    key = F.unhex(F.md5(F.concat_ws("\x1f", "src", F.coalesce("location", F.lit("")), "core", "kinds", "city", "zip", F.array_join("phones", ","), F.coalesce(spot, F.lit("")))))
    kept = ("src", "location", "number", "street", "direction", "type", "unit", "city", "zip", "core", "kinds", "phones")
    rows, rows_at = materialize(full.select(key.alias("key"), "row_id", *kept, "lat", "lng"), "profiled")
    for path in stages:
        discard(spark, path)
    # pairs carry numbers, which take a fraction of the room of keys
    numbered = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in kept], F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).withColumn("pid", F.monotonically_increasing_id())
    profiles, _ = materialize(numbered, "profiles")
    member = rows.select("key", "src", F.col("row_id").alias("rid")).join(profiles.select("key", "pid"), "key").select("pid", "src", "rid").distinct()
    members, _ = materialize(member.withColumn("multi", F.count("*").over(Window.partitionBy("src", "rid")) > 1), "members")
    discard(spark, rows_at)
    return profiles.drop("key"), members


def name_keys(core: Column) -> tuple[Column, Column]:
    """(asked, kept): keys that two names share, one's asked and the other's kept, if like words cover seven tenths of their letters.

    Such names have two like words, or one that is most of either name and half of the other. A word stands in a key by
    its start or its end, of which a letter lost, added, changed or swapped leaves one whole.
    """
    none = F.array().cast("array<string>")
    words = F.when(core != "", F.split(core, " ")).otherwise(none)
    ends = lambda w, tag, n: F.array(F.concat(F.lit(f"{tag}<"), F.left(w, F.lit(n))), F.concat(F.lit(f"{tag}>"), F.right(w, F.lit(n))))

    def parts(w: Column) -> Column:
        n = F.length(w)
        some = lambda at, tag, k: F.when(at, ends(w, tag, k)).otherwise(none)
        return F.concat(some(n <= 4, "a", 1), some((n >= 4) & (n <= 6), "b", 2), some(n >= 6, "c", 3), some(n >= 8, "d", 2))

    def both(v: Column, w: Column) -> Column:
        return F.flatten(F.transform(parts(v), lambda x: F.transform(parts(w), lambda y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y)))))

    twos = F.flatten(F.flatten(F.transform(words, lambda v, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda w: both(v, w)).cast("array<array<string>>"))))
    total = F.length(F.regexp_replace(core, " ", ""))

    def ones(most: Sequence[str], half: Sequence[str]) -> Column:
        tagged = lambda w, tags: F.flatten(F.array(*[F.transform(parts(w), lambda x: F.concat(F.lit(t), x)) for t in tags]))  # noqa: B023, E731
        return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 0.65 * total, tagged(w, most)).when(F.length(w) >= 0.45 * total, tagged(w, half)).otherwise(none)))

    return F.concat(twos, ones(["mm", "mh"], ["hm"])), F.concat(twos, ones(["mm", "hm"], ["mh"]))


def candidates(p: DataFrame) -> DataFrame:
    """(pa, pb) with pa < pb, each pair of profiles that share a block, once. Only ids and hashed keys are shuffled.

    Located records meet in one city, house number and street if they share the first or last three
    letters of a word of the name (one typo leaves one of them) or a phone; a record that lacks an
    address meets others that share a key of :func:`name_keys` and the digits of the ZIP in any order (the city where
    either has no ZIP), name and city, or phone and city.
    """
    tokens = F.when(F.col("core") != "", F.split("core", " ")).otherwise(F.array().cast("array<string>"))
    block = F.concat_ws("|", "city", "number", "street")
    none = F.array().cast("array<string>")
    letters = F.concat(F.transform(tokens, lambda t: F.concat(F.lit("<"), F.left(t, F.lit(3)))), F.transform(tokens, lambda t: F.concat(F.right(t, F.lit(3)), F.lit(">"))))
    ends = F.concat(letters, F.col("phones"))
    hashed = lambda keys: F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))).alias("k")
    at = p.where("location IS NOT NULL").select("pid", hashed(F.transform(ends, lambda e: F.concat(block, F.lit("|"), e))))
    digits = F.array_join(F.array_sort(F.split("zip", "")), "")
    asked, held = name_keys(F.col("core"))
    p = p.select("pid", "location", "core", "city", "zip", "phones", digits.alias("digits"), asked.alias("asked"), held.alias("held"))
    in_zip = lambda keys: F.when(F.col("zip") != "", F.transform(keys, lambda e: F.concat_ws("|", F.lit("z"), e, F.col("digits")))).otherwise(none)
    in_city = lambda keys, kind: F.when(F.col("city") != "", F.transform(keys, lambda e: F.concat_ws("|", F.lit(kind), e, F.col("city")))).otherwise(none)
    name = F.when((F.col("core") != "") & (F.col("city") != ""), F.array(F.concat_ws("|", F.lit("c"), "core", "city"))).otherwise(none)
    shared = F.concat(name, F.transform("phones", lambda x: F.concat_ws("|", F.lit("p"), x, F.col("city"))))
    # name and city: a record without ZIP meets all, one with ZIP those without
    every = p.select(F.col("pid").alias("y"), hashed(F.concat(shared, in_zip("held"), in_city("held", "e"), F.when(F.col("zip") == "", in_city("held", "u")).otherwise(none))))
    lost = p.where("location IS NULL").select(F.col("pid").alias("x"), hashed(F.concat(shared, in_zip("asked"), F.when(F.col("zip") == "", in_city("asked", "e")).otherwise(in_city("asked", "u")))))
    near = at.withColumnRenamed("pid", "pa").join(at.withColumnRenamed("pid", "pb"), "k").where("pa < pb").select("pa", "pb")
    # keys that no lost record asks for are dropped before any is sent: a bitmap of 2^26 bits, at most 2^20 rows
    slot, bit = F.expr("pmod(shiftrightunsigned(k, 6), 1048576)").alias("slot"), F.expr("shiftleft(1L, CAST(k & 63 AS INT))")
    wanted = lost.groupBy(slot).agg(F.bit_or(bit).alias("bits"))
    every = every.select("y", "k", slot).join(F.broadcast(wanted), "slot").where(F.col("bits").bitwiseAND(bit) != 0).select("y", "k")
    # two lost records meet by either's keys
    far = lost.join(every, "k").where("x <> y").select(F.least("x", "y").alias("pa"), F.greatest("x", "y").alias("pb"))
    return near.unionByName(far).distinct()


def code(values: Sequence[Column]) -> Column:
    """One number for a vector of small integers from -1 to ``STEPS``."""
    return sum(((v + 1) * RADIX**i for i, v in enumerate(values)), F.lit(0)).cast("int")


def decoded(v: np.ndarray) -> np.ndarray:
    """The vectors behind :func:`code`, one row each."""
    return np.stack([v // RADIX**i % RADIX - 1 for i in range(len(FEATURES))], axis=1).astype(float)


def feature(name: str) -> Column:
    return F.floor(F.col("v") / RADIX ** FEATURES.index(name)) % RADIX - 1


def vectors(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(a, b, side, v) for pairs of profiles: ``v`` is the :func:`code` of small integers 0..STEPS, or -1 for
    unknown, for each of ``FEATURES``; ``side`` is 0 within a source, 1 where a is of source 'l', 2 where b is.
    """
    @F.pandas_udf("double")
    def likeness(ca: pd.Series, ka: pd.Series, cb: pd.Series, kb: pd.Series) -> pd.Series:
        return pd.Series([name_likeness(*x) for x in zip(ca, ka, cb, kb)], dtype="float64")

    # equality of places is all that is asked, so their keys travel as hashes
    at = F.when(F.col("location").isNotNull(), F.xxhash64("location")).alias("at")
    slim = F.struct("src", at, F.xxhash64("city", "number", "street").alias("street"), "direction", "type", "unit", "zip", "core", "kinds", "phones", "lat", "lng")
    end = lambda s: p.select(F.col("pid").alias(f"p{s}"), slim.alias(s))
    j = pairs.join(end("a"), "pa").join(end("b"), "pb")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    missing = a("at").isNull() | b("at").isNull()
    street = a("street") == b("street")
    agree = lambda c: (a(c) == b(c)) | (a(c) == "") | (b(c) == "")
    address = F.when(missing, -1.0).when(a("at") == b("at"), 1.0).when(street & agree("direction") & agree("type") & agree("unit"), 0.8).when(street & (a("direction") == b("direction")) & (a("type") == b("type")), 0.3).when(street, 0.2).otherwise(0.0)
    z = F.levenshtein(a("zip"), b("zip"))
    postal = F.when((a("zip") == "") | (b("zip") == ""), -1.0).when(z == 0, 1.0).when((z == 1) | ((z == 2) & (F.array_sort(F.split(a("zip"), "")) == F.array_sort(F.split(b("zip"), "")))), 0.8).otherwise(0.0)
    phone = F.when((F.size(a("phones")) == 0) | (F.size(b("phones")) == 0), -1.0).when(F.arrays_overlap(a("phones"), b("phones")), 1.0).otherwise(0.0)
    km = 111.2 * F.sqrt(F.pow(a("lat") - b("lat"), 2) + F.pow((a("lng") - b("lng")) * F.cos(F.radians(a("lat"))), 2))
    # between two located records the address says more than the pins, which are often damaged
    place = F.when(~missing | km.isNull(), -1.0).when(km < 0.2, 1.0).when(km < 0.5, 0.7).when(km < 2, 0.3).otherwise(0.0)
    small = lambda c: F.when(c < 0, -1).otherwise(F.round(c * STEPS)).cast("int")
    side = F.when(a("src") == b("src"), 0).when(a("src") == "l", 1).otherwise(2).cast("byte").alias("side")
    cols = j.select(F.col("pa").alias("a"), F.col("pb").alias("b"), side, a("core").alias("ca"), a("kinds").alias("ka"), b("core").alias("cb"), b("kinds").alias("kb"), *[small(c).alias(f) for f, c in (("address", address), ("postal", postal), ("phone", phone), ("place", place))])
    named = cols.select("a", "b", "side", small(likeness("ca", "ka", "cb", "kb")).alias("name"), *FEATURES[1:])
    return named.select("a", "b", "side", code([F.col(f) for f in FEATURES]).alias("v"))


def likely(x: np.ndarray) -> np.ndarray:
    """Which vectors start as matches: alike by four fifths in what is known, and alike in name."""
    there = x >= 0
    return (np.where(there, x, 0).sum(axis=1) / np.maximum(1, there.sum(axis=1)) / STEPS > 0.8) & (x[:, 0] > 0.7 * STEPS)


def closed(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """``pairs`` (of :func:`vectors`) and the third side of every path of two strong links, until none is new.

    A link is strong where its similarities would start it as a match. Each pass takes paths with a link of the last one.
    """
    x = [feature(f) for f in FEATURES]
    total, known = sum(F.greatest(c, F.lit(0)) for c in x), sum((c >= 0).cast("int") for c in x)
    strong = lambda df: df.where((total > 0.8 * STEPS * known) & (x[0] > 0.7 * STEPS)).select("a", "b")

    def links(df: DataFrame, end: str) -> DataFrame:
        return df.select(F.col("a").alias("mid"), F.col("b").alias(end)).unionByName(df.select(F.col("b").alias("mid"), F.col("a").alias(end)))

    fresh = pairs
    while True:
        thirds = links(strong(fresh), "x").join(links(strong(pairs), "y"), "mid").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = thirds.join(pairs.select("a", "b"), ["a", "b"], "left_anti").withColumnsRenamed({"a": "pa", "b": "pb"})
        fresh, path = materialize(vectors(new, p), "thirds")
        if fresh.isEmpty():
            discard(pairs.sparkSession, path)
            return pairs
        pairs = pairs.unionByName(fresh)


class Mixture:
    """Matched (1) and unmatched (0) Gaussians with diagonal covariances over histogram vectors.

    Each feature's density is mixed with a uniform one of weight ``STRAY``, so one wrong value (a phone of
    somebody else) cannot outvote all other features.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, gamma: np.ndarray, strength: float = 0.15):
        self.x, self.there, self.w, self.strength = x / STEPS, x >= 0, weight, strength
        self.fit(gamma)

    def fit(self, gamma: np.ndarray) -> None:
        """Maximisation from the responsibilities of the matched component."""
        d = self.x.shape[1]
        self.mean, self.var = np.zeros((2, d)), np.ones((2, d))
        share = np.array([(self.w * (1 - gamma)).sum(), (self.w * gamma).sum()]) + 1.0
        self.prior = share / share.sum()
        for k, g in enumerate((1 - gamma, gamma)):
            for j in range(d):
                m = self.w * g * self.there[:, j]
                n = m.sum() + 1e-9
                self.mean[k, j] = (m @ self.x[:, j]) / n if n > 1e-6 else 0.5
                self.var[k, j] = (m @ (self.x[:, j] - self.mean[k, j]) ** 2) / n
        self.var += (self.strength * (self.mean[1] - self.mean[0])) ** 2 + 1e-3

    def posterior(self) -> np.ndarray:
        odds = np.full(len(self.x), np.log(self.prior[1] / self.prior[0]))
        for j in range(self.x.shape[1]):
            p = [(1 - STRAY[j]) / np.sqrt(2 * np.pi * v) * np.exp(-((self.x[:, j] - m) ** 2) / (2 * v)) + STRAY[j] for m, v in zip(self.mean[:, j], self.var[:, j])]
            odds += np.where(self.there[:, j], np.log(p[1] / p[0]), 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def weighed(pairs: DataFrame, codes: np.ndarray, gamma: np.ndarray) -> DataFrame:
    """``pairs`` with the posterior of their vector: a table of at most 22 x 7 x 5 x 4 x 6 rows, whatever the number of pairs."""
    look = pairs.sparkSession.createDataFrame(pd.DataFrame({"v": codes.astype("int32"), "gamma": gamma}), "v int, gamma double")
    return pairs.join(F.broadcast(look), "v")


def repairs(scored: DataFrame) -> DataFrame:
    """(a, b, v, g, up, down): what triangles of candidate pairs ask of the gamma ``g`` of a pair.

    Where gamma(a,b) gamma(b,c) exceeds gamma(a,c), the cheaper repair in log-odds is taken: raise the third side to
    the product (``up``), or lower the weaker of the two links (``down``). Only links of 0.5 and more can bind, and
    rows with ``low`` are not raised.
    """
    strong = scored.where("gamma >= 0.5").select("a", "b", "v", "gamma")
    both = strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "v", "gamma"))
    leg = lambda e: both.select(F.col("b").alias("mid"), F.col("a").alias(e), F.col("v").alias(f"v{e}"), F.col("gamma").alias(f"g{e}"))
    weak = scored.where("gamma < 0.999").select(F.col("a").alias("x"), F.col("b").alias("y"), "v", F.col("gamma").alias("g"), "low")
    bad = leg("x").join(leg("y"), "mid").where("x < y").join(weak, ["x", "y"]).where("gx * gy > g + 1e-6")
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c) + 1e-12) + 1e-12)
    lift = ~F.col("low") & (odds("g") + F.least(odds("gx"), odds("gy")) >= 0)
    end = lambda e, other: F.struct(F.least(e, "mid").alias("a"), F.greatest(e, "mid").alias("b"), F.col(f"v{e}").alias("v"), F.col(f"g{e}").alias("g"), F.lit(None).cast("double").alias("up"), F.least(F.col(f"g{e}"), F.col("g") / F.col(f"g{other}")).alias("down"))
    raised = F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "v", "g", (F.col("gx") * F.col("gy")).alias("up"), F.lit(None).cast("double").alias("down"))
    asked = bad.select(F.when(lift, raised).when(F.col("gx") <= F.col("gy"), end("x", "y")).otherwise(end("y", "x")).alias("c")).select("c.*")
    return asked.groupBy("a", "b", "v", "g").agg(F.max("up").alias("up"), F.min("down").alias("down"))


def transitive(scored: DataFrame) -> DataFrame:
    """``scored`` (a, b, v, gamma, low, ...) after one pass of :func:`repairs`; ``low`` and ``moved`` say what it did."""
    asked = repairs(scored).select("a", "b", "up", "down")
    done = scored.join(asked, ["a", "b"], "left").withColumn("low", F.col("low") | (F.col("up").isNull() & F.col("down").isNotNull())).withColumn("moved", F.col("up").isNotNull() | F.col("down").isNotNull())
    return done.withColumn("gamma", F.coalesce("up", "down", "gamma")).drop("up", "down")


def settled(scored: DataFrame) -> DataFrame:
    """:func:`transitive` until no triangle asks for a change. A pair once lowered is never raised again, so it ends."""
    now, old = scored.withColumn("low", F.lit(False)), None
    while True:
        now, path = materialize(transitive(now.drop("moved")), "settled")
        if old:
            discard(scored.sparkSession, old)
        old = path
        if now.where("moved").isEmpty():
            return now.drop("low", "moved")


def match(records: DataFrame, rounds: int = 3, inner: int = 25, least: float = 0.0) -> DataFrame:
    """(left_id, right_id, posterior) of every candidate pair between the sources 'l' and 'r' whose posterior is at least ``least``.

    ``records``: src, rid (string), name, address, city_text, state_text, postal, phones (array of the last ten
    digits, sorted, distinct), lat, lng. Rows without id match nothing; repeated rows are kept as one pair. Any
    other column may be null. Pairs that share no block and are no third side of strong links have no row: their posterior counts as 0.
    """
    spark = records.sparkSession
    profiles, members = profile(records.where("rid IS NOT NULL"))
    met, met_at = materialize(candidates(profiles), "candidates")
    blocked, _ = materialize(vectors(met, profiles), "vectors")
    discard(spark, met_at)
    pairs = closed(blocked, profiles)
    # at most one row per vector: 22 x 7 x 5 x 4 x 6, whatever the number of pairs
    with tidy(spark):
        hist = pairs.groupBy("v").count().toPandas().sort_values("v")
    if hist.empty:
        return members.select(F.col("rid").alias("left_id"), F.col("rid").alias("right_id"), F.lit(0.0).alias("posterior")).limit(0)
    codes, weight = hist["v"].to_numpy(), hist["count"].to_numpy(float)
    x = decoded(codes)
    mix = Mixture(x, weight, likely(x).astype(float))
    for r in range(rounds):
        for _ in range(inner):
            mix.fit(mix.posterior())
        gamma = mix.posterior()
        if r < rounds - 1:
            # maximise from the corrected responsibilities of all pairs: the vector's own, moved by what triangles ask
            with tidy(spark):
                asked = repairs(weighed(pairs, codes, gamma).withColumn("low", F.lit(False)))
                moves = asked.groupBy("v").agg(F.sum(F.coalesce("up", "down") - F.col("g")).alias("d")).toPandas()
            shift = np.zeros(len(codes))
            shift[np.searchsorted(codes, moves["v"].to_numpy())] = moves["d"].to_numpy(float)
            mix.fit(np.clip(gamma + shift / weight, 0.0, 1.0))
    scored = settled(weighed(pairs, codes, mix.posterior()))
    cross = scored.where((F.col("side") > 0) & (F.col("gamma") >= least)).select(F.when(F.col("side") == 1, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(F.col("side") == 1, F.col("b")).otherwise(F.col("a")).alias("r"), F.col("gamma").alias("posterior"))
    end = lambda s: members.where(F.col("src") == s).select(F.col("pid").alias(s), F.col("rid").alias(f"{s}_id"), F.col("multi").alias(f"{s}_multi"))
    found = cross.join(end("l"), "l").join(end("r"), "r").withColumnsRenamed({"l_id": "left_id", "r_id": "right_id"})
    # only ids behind several profiles can bring a pair twice; all other pairs are never sorted or sent
    twice = F.col("l_multi") | F.col("r_multi")
    once = found.where(~twice).select("left_id", "right_id", "posterior")
    if members.where("multi").isEmpty():
        return once
    return once.unionByName(found.where(twice).groupBy("left_id", "right_id").agg(F.max("posterior").alias("posterior")))


def last_ten(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def venue_records(restaurants: DataFrame, places: DataFrame) -> DataFrame:
    """Restaurants as source 'l' and places as source 'r' in the shape that :func:`match` takes."""
    phones = lambda c: F.array_sort(F.array_distinct(F.array_compact(c)))
    left = restaurants.select(F.lit("l").alias("src"), F.col("id").cast("string").alias("rid"), "name", "address", F.col("city").alias("city_text"), F.col("state").alias("state_text"), F.col("postal_code").alias("postal"), phones(F.array(last_ten(F.col("phone")))).alias("phones"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lng"))
    some = F.coalesce(F.col("phones"), F.array().cast("array<string>"))
    right = places.select(F.lit("r").alias("src"), F.col("id").alias("rid"), "name", F.col("street").alias("address"), F.col("city").alias("city_text"), F.col("region").alias("state_text"), F.col("postcode").alias("postal"), phones(F.transform(some, last_ten)).alias("phones"), "lat", "lng")
    return left.unionByName(right)


def match_venues(restaurants: DataFrame, places: DataFrame, **kw) -> DataFrame:
    """(restaurant_id, place_id, posterior) over all candidate pairs; see :func:`match`."""
    return match(venue_records(restaurants, places), **kw).select(F.col("left_id").cast("long").alias("restaurant_id"), F.col("right_id").alias("place_id"), "posterior")
