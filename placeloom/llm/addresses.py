"""Postal address parsing and canonical locations.

Each address is parsed into components, abbreviations are expanded with dictionaries of the locale,
and components are put in one order whatever order they were written in. Misspelled cities and
streets are mapped to the spelling that more rows use, found through shared one-letter deletions
(never by comparing all spellings). Rows then meet on hierarchical keys: city, house number and street
first, then direction, type and unit with explicit rules for what is missing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import materialize

# Street types of the postal service, directions, and opening words of street names with their usual abbreviations.
TYPES = {
    "alley": "aly allee ally", "annex": "anx annx", "arcade": "arc", "avenue": "ave av aven avenu avn avnue", "bayou": "byu", "beach": "bch", "bend": "bnd", "bluff": "blf bluf", "boulevard": "blvd boul bvd blv boulv", "branch": "br brnch", "bridge": "brg brdge",
    "brook": "brk", "bypass": "byp bypa", "canyon": "cyn canyn", "causeway": "cswy causwa", "center": "ctr cen cent centr centre", "circle": "cir circ circl crcl", "common": "cmn", "corner": "cor", "corners": "cors", "court": "ct crt", "courts": "cts", "cove": "cv", "creek": "crk",
    "crescent": "cres crsent", "crossing": "xing crssng", "crossroad": "xrd", "dale": "dl", "drive": "dr drv driv", "estate": "est", "estates": "ests", "expressway": "expy exp expr expw", "extension": "ext extn", "falls": "fls", "ferry": "fry frry", "field": "fld", "flats": "flts", "ford": "frd",
    "forest": "frst", "fork": "frk", "freeway": "fwy freewy frway", "garden": "gdn gardn", "gardens": "gdns", "gateway": "gtwy", "glen": "gln", "green": "grn", "grove": "grv grov", "harbor": "hbr harbr", "haven": "hvn", "heights": "hts ht", "highway": "hwy hiway hgwy highwy hway", "hill": "hl",
    "hills": "hls", "hollow": "holw hollw", "island": "is islnd", "isle": "isles", "junction": "jct jctn", "knoll": "knl", "lake": "lk", "landing": "lndg", "lane": "ln", "lights": "lgts", "loop": "lp loops", "mall": "", "manor": "mnr", "meadow": "mdw", "meadows": "mdws", "mews": "", "mill": "ml",
    "motorway": "mtwy", "mountain": "mtn", "orchard": "orch", "oval": "ovl", "overpass": "opas", "park": "prk pk", "parkway": "pkwy pky pkway parkwy", "pass": "", "path": "paths", "pike": "pikes", "pine": "pne", "place": "pl", "plain": "pln", "plaza": "plz plza", "point": "pt", "prairie": "pr",
    "promenade": "prom", "ranch": "rnch", "ridge": "rdg rdge", "river": "riv rvr", "road": "rd", "roads": "rds", "route": "rte", "row": "", "run": "", "shore": "shr", "spring": "spg", "springs": "spgs", "spur": "", "square": "sq sqr squ", "station": "sta statn", "stream": "strm",
    "street": "st str strt", "summit": "smt", "terrace": "ter terr", "trace": "trce", "track": "trak", "trail": "trl trails", "tunnel": "tunl", "turnpike": "tpke turnpk", "underpass": "upas", "union": "un", "valley": "vly vlly", "viaduct": "via", "view": "vw", "village": "vlg villg", "ville": "vl",
    "vista": "vis vst", "walk": "walks", "way": "wy", "well": "wl", "wells": "wls",
}
#: Types that count as types wherever they follow a name; the others are words of the name, in full.
HARD_TYPES = {
    "alley", "avenue", "boulevard", "bypass", "causeway", "circle", "court", "courts", "cove", "crescent", "drive", "expressway", "extension", "freeway", "highway", "lane", "loop", "motorway", "parkway", "pass", "path", "pike", "place", "plaza", "promenade", "road", "roads", "route", "row",
    "run", "square", "street", "terrace", "trail", "turnpike", "walk", "way",
}
DIRECTIONS = {"north": "n no", "south": "s so", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
NAME_WORDS = {"saint": "st ste", "mount": "mt", "fort": "ft", "port": "pt prt", "point": "pnt"}
# Abbreviations of words in names of cities; where one stands for several, the word used by more rows is taken, else the first.
CITY_WORDS = {
    "n": "north new", "no": "north", "nw": "new northwest", "s": "south san", "so": "south", "e": "east", "w": "west", "ne": "northeast", "se": "southeast", "sw": "southwest", "st": "saint", "ste": "sainte saint", "mt": "mount mountain", "mtn": "mountain", "ft": "fort", "pt": "port point", "prt": "port", "pnt": "point", "lk": "lake", "gln": "glen", "gr": "grand great",
    "vlg": "village", "spg": "spring", "spgs": "springs", "hts": "heights", "bch": "beach", "ctr": "center", "cyn": "canyon", "hbr": "harbor", "is": "island", "jct": "junction", "lks": "lakes", "pk": "park", "rdg": "ridge", "rvr": "river", "twp": "township", "vly": "valley", "fls": "falls", "gdns": "gardens", "hls": "hills", "grv": "grove", "twn": "town", "vlla": "villa",
}
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]
STATES = {
    "district of columbia": "dc", "puerto rico": "pr", "american samoa": "as", "virgin islands": "vi", "northern mariana islands": "mp",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "guam": "gu", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}


def spellings(words: dict[str, str]) -> dict[str, str]:
    return {s: full for full, short in words.items() for s in [full, *short.split()]}


TYPE_OF, DIRECTION_OF, NAME_WORD_OF = map(spellings, (TYPES, DIRECTIONS, NAME_WORDS))
CITY_WORD_OF = {k: v.split() for k, v in CITY_WORDS.items()}
#: Abbreviations that only open the name of a city.
OPENING = {"n", "no", "nw", "ne", "s", "so", "se", "sw", "e", "w", "st", "ste", "ft", "pt", "prt", "gr", "lk", "mt", "gln", "vlla", "pnt", "is"}
ORDINAL_OF = {w: f"{i}{'st' if i == 1 else 'nd' if i == 2 else 'rd' if i == 3 else 'th'}" for i, w in enumerate(ORDINALS, 1)}
STATE_CODES = set(STATES.values())
COUNTRY = re.compile(r"[,\s]+(?:u\.?s\.?a?\.?|united states(?: of america)?)\s*$")
UNIT = re.compile(r"(?:\b(?:suite|ste|unit|apt|apartment|room|rm|bldg|building|space|spc)\b\.?\s*#?\s*|#\s*)([a-z]?-?\d{1,5}[a-z]?|[a-z])\b")
ZIP = re.compile(r"\b(\d{5})(?:-\d{4})?\s*$")
FIELDS = ["number", "street", "direction", "type", "unit", "city", "state", "zip"]


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def words_of(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", s.replace("'", ""))


def city_key(s: str | None) -> str:
    """Letters of the city with abbreviated words expanded; '' where it names none.

    An opening word with several expansions stays as it is, before a stop (``n.hesterly``): :func:`canonical` decides.
    """
    w = words_of(fold(s or ""))
    lead = ""
    if len(w) > 1:
        w = [w[0], *(CITY_WORD_OF[x][0] if x in CITY_WORD_OF and x not in OPENING else x for x in w[1:])]
        many = CITY_WORD_OF.get(w[0], [])
        if len(many) > 1:
            lead, w = w[0] + ".", w[1:]
        elif many:
            w[0] = many[0]
    key = "".join(w)
    return lead + key if re.search("[a-z]", key) and key not in ("null", "none", "unknown", "na", "city") else ""


def expansions(key: str) -> list[str]:
    """The full forms that a :func:`city_key` may stand for, the usual one first."""
    lead, stop, rest = key.partition(".")
    return [x + rest for x in CITY_WORD_OF[lead]] if stop else [key]


def same_city(a: str, b: str) -> bool:
    return any(near(x, y) for x in expansions(a) for y in expansions(b))


def near(a: str, b: str) -> bool:
    """Equal but for one inserted, lost, changed or swapped letter (two in names of eight or more)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or not a or not b:
        return False
    return edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 8 else 1)


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent swaps), given up above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def split_street(w: list[str], city: str) -> tuple[str, str, str, str]:
    """(direction, street, type, city) of words that begin with a street and may go on to a city."""
    direction = kind = ""
    if len(w) > 1 and w[0] in DIRECTION_OF and not (len(w) == 2 and w[1] in TYPE_OF):
        direction, w = DIRECTION_OF[w[0]], w[1:]
    hard = [TYPE_OF.get(x) in HARD_TYPES for x in w]
    at = next((i for i in range(1, len(w)) if hard[i]), None)
    # the last of several in a row (bull run road), unless it opens a city (oak avenue saint louis)
    while at is not None and at + 1 < len(w) and hard[at + 1] and not (w[at + 1] in NAME_WORD_OF and at + 2 < len(w)):
        at += 1
    if at is None:
        rest, name = [], w
        for k in (3, 2, 1):  # a city that follows without a comma
            if city and len(w) > k and same_city(city_key(" ".join(w[-k:])), city):
                name, rest = w[:-k], w[-k:]
                break
        if len(name) > 1 and name[-1] in DIRECTION_OF and not direction:
            direction, name = DIRECTION_OF[name[-1]], name[:-1]
    else:
        name, kind, rest = w[:at], TYPE_OF[w[at]], w[at + 1 :]
        if rest and rest[0] in DIRECTION_OF and not (len(rest) > 1 and city and rest[0] in CITY_WORD_OF and same_city(city_key(" ".join(rest)), city)) and (len(rest) != 2 or (city and same_city(city_key(rest[1]), city))):
            direction, rest = direction or DIRECTION_OF[rest[0]], rest[1:]
    if len(name) > 1:
        name[0] = NAME_WORD_OF.get(name[0], name[0])
    name = name[:1] + [TYPE_OF.get(x, x) for x in name[1:]]
    return direction, "".join(ORDINAL_OF.get(x, x) for x in name), kind, city_key(" ".join(rest))


def parse(address: str | None, city: str | None = None, state: str | None = None, postal: str | None = None) -> tuple[str, ...]:
    """The ``FIELDS`` of one row as canonical words, '' for what is missing.

    City, state and ZIP come from their columns and, where those are blank, from the address.
    ``number`` and ``street`` are '' together when the address names no street.
    """
    city_col = city_key(city)
    st = fold(state or "").strip()
    st = STATES.get(st, st)
    z = re.match(r"\s*(\d{4,5})(?!\d)", postal or "")
    zip5 = z.group(1).zfill(5) if z else ""
    s = COUNTRY.sub("", re.sub(r"\([^)]*\)", " ", fold(address or "")).strip().rstrip(","))
    s = re.sub(r"\s+-\s+|[\n\r;]+", ", ", s)
    unit = ""
    m = UNIT.search(s)
    if m:
        unit = m.group(1).replace("-", "")
        s = s[: m.start()] + " " + s[m.end() :]
    parts = [p.strip(" .") for p in s.split(",")]
    parts = [p for p in parts if p]
    number = street_text = a_city = a_state = a_zip = ""
    texts: list[str] = []
    for p in parts:
        zipped = False
        m = ZIP.search(p)
        if m and (p == m.group(0).strip() or re.search("[a-z]", p[: m.start()])) and not (p.isdigit() and not number and not a_city and len(texts) == 1 and parts.index(p) == 1 and zip5 != p[:5]):
            a_zip, p, zipped = m.group(1), p[: m.start()].strip(" .,"), True
            if not p:
                continue
        w = words_of(p)
        if w and w[-1] in STATE_CODES and (len(w) == 1 or zipped or len(w) > 2) and not (len(w) == 1 and w[0] in DIRECTION_OF and not zipped and not texts and not street_text):
            if len(w) == 1:
                a_state = w[0]
                continue
            # a state after a city, not a type or direction after a street
            if (w[-1] not in TYPE_OF and w[-1] not in DIRECTION_OF) or w[-1] == st or zipped:
                a_state, w = w[-1], w[:-1]
        if not w:
            continue
        m = re.fullmatch(r"\d{1,6}[a-z]?", w[0])
        if m and not number:
            number = w[0]
            if len(w) > 1:
                street_text = " ".join(w[1:])
            elif texts:
                street_text = texts.pop()
            continue
        texts.append(" ".join(w))
    if number and not street_text and texts:
        street_text = texts.pop(0)
    direction = street = kind = ""
    if number and street_text:
        direction, street, kind, a_city = split_street(street_text.split(), city_col)
        if texts and not a_city:
            a_city = city_key(texts[-1])
    elif texts:
        a_city = city_key(texts[-1])
    if not re.search("[a-z]", street):
        number = street = direction = kind = unit = ""
    return number, street, direction, kind, unit, city_col or a_city, st or a_state, zip5 or a_zip


def parsed(rows: DataFrame, row_id: str, address: str, city: str, state: str, postal: str, *keep: str, extra: tuple[str, list[str], Callable] | None = None) -> DataFrame:
    """(row_id, number, street, direction, type, unit, city, state, zip, *keep) for every row.

    ``extra`` names one more column, the string fields read from it and the function that reads them from its value
    and the city, so that the same Python pass serves both.
    """
    column, fields, read = extra or (address, [], None)
    out = FIELDS + fields

    @F.pandas_udf(", ".join(f"{f} string" for f in out))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            found = []
            for *x, other in zip(*(c.astype(object).where(c.notna(), None) for c in cols)):
                p = parse(*x)
                found.append(p + read(other, p[5]) if read else p)
            yield pd.DataFrame(found, columns=out)

    return rows.select(F.col(row_id).alias("row_id"), *keep, run(*[F.col(c).cast("string") for c in (address, city, state, postal, column)]).alias("_p")).select("row_id", *keep, "_p.*")


def deletions(word: Column) -> Column:
    """The word and every word that lacks one of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1000))))
    return F.array_distinct(F.concat(F.array(word), cut))


def respelled(words: DataFrame, word: str, count: str, times: float = 2.0) -> DataFrame:
    """(word, better): spellings to be replaced by one that ``times`` as many rows use and that differs
    by one letter lost, added, changed or swapped with the next. Words that start with a digit stay.

    Two such spellings share a deletion. A deletion is shared by few spellings however many there are (one letter more
    at one of its places), so all of them are held against each other.
    """
    w = words.select(F.col(word).alias("word"), F.col(count).alias("n")).where(F.col("word").rlike("^[a-z]") & (F.length("word") >= 4))
    keyed = w.select("word", "n", F.explode(deletions(F.col("word"))).alias("key"))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    far = F.levenshtein("word", "better")
    found = keyed.join(keyed.select("key", F.col("word").alias("better"), F.col("n").alias("m")), "key").where((F.col("m") >= times * F.col("n")) & (F.col("word") != F.col("better")))
    close = found.where((far <= 1) | ((far == 2) & (F.length("word") == F.length("better")) & (letters(F.col("word")) == letters(F.col("better")))))
    return close.groupBy("word").agg(F.max(F.struct("m", "better")).alias("b")).select("word", "b.better")


def city_spellings(counts: DataFrame) -> DataFrame:
    """(city, better) for counts (city, n): abbreviations with several readings take the one more rows use, then misspellings go."""
    spark = counts.sparkSession
    table = spark.createDataFrame([(k, i, x) for k, v in CITY_WORD_OF.items() for i, x in enumerate(v) if len(v) > 1], "lead string, i int, full string")
    short = counts.where("instr(city, '.') > 0").select("city", "n", F.split_part("city", F.lit("."), F.lit(1)).alias("lead"), F.split_part("city", F.lit("."), F.lit(2)).alias("rest"))
    read = short.join(F.broadcast(table), "lead").select("city", "n", "i", F.concat("full", "rest").alias("plain"))
    whole = counts.where("instr(city, '.') = 0")
    used = read.join(whole.select(F.col("city").alias("plain"), F.col("n").alias("m")), "plain", "left")
    chosen = used.groupBy("city", "n").agg(F.max_by("plain", F.struct(F.coalesce("m", F.lit(0)), -F.col("i"))).alias("plain"))
    plain = whole.select("city", "n", F.col("city").alias("plain")).unionByName(chosen.select("city", "n", "plain"))
    better = respelled(plain.groupBy("plain").agg(F.sum("n").alias("n")), "plain", "n").withColumnRenamed("word", "plain")
    return plain.join(better, "plain", "left").select("city", F.coalesce("better", "plain").alias("better")).where("city <> better")


def canonical(parts: DataFrame, keep_unlocated: bool = False, stages: list[str] | None = None) -> DataFrame:
    """Adds ``location`` to parsed rows (``parts`` must be a stored table: it is read several times).

    ``location`` is a key shared by all rows that denote one location; rows for which no street or city is known
    have none and are left out, or kept with a null ``location``. Paths of stored stages are added to ``stages``.
    Rules for what is missing, applied in this order:
    city: the ZIP's most frequent city; still none: no location.
    direction, type: the only one that rows of the same city, number and street write and that agrees with the
    rest of the row; if they write several, or none, what is missing stays a value of its own.
    unit: never filled in; a row without unit is another location than a row with one.
    State and ZIP take no part in the key: cities are told apart by name.
    """
    def looked_up(df: DataFrame, m: DataFrame, col: str, value: str) -> DataFrame:
        """``df`` with ``value`` of ``m`` (one row per ``col``). Blank keys find nothing and are spread, not sent to one task."""
        key = F.when(F.col(col) == "", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("row_id", "city", "zip", "street"), F.lit(997)))).otherwise(F.col(col))
        return df.withColumn("_k", key).join(m.select(F.col(col).alias("_k"), value), "_k", "left").drop("_k")

    # all that is learnt from the rows is counted per spelling; the rows themselves are stored once
    words, path = materialize(city_spellings(parts.where("city <> ''").groupBy("city").agg(F.count("*").alias("n"))).withColumnRenamed("better", "_b"), "city-words")
    zips = parts.where("zip <> '' AND city <> ''").groupBy("zip", "city").count().join(words, "city", "left")
    zip_city = zips.groupBy("zip", F.coalesce("_b", "city").alias("c")).agg(F.sum("count").alias("n")).groupBy("zip").agg(F.max_by("c", F.struct("n", "c")).alias("_zc"))
    streets = respelled(parts.where("number <> '' AND street <> ''").groupBy("street").count(), "street", "count").withColumnsRenamed({"word": "street", "better": "_s"})
    filled = looked_up(parts, words, "city", "_b").withColumn("city", F.coalesce("_b", "city"))
    filled = looked_up(filled, zip_city, "zip", "_zc").withColumn("_lost", F.col("city") == "").withColumn("city", F.when(F.col("_lost"), F.coalesce("_zc", "city")).otherwise(F.col("city")))
    # a city that follows the street without a comma or a type could not be told apart before
    tail = F.col("_lost") & (F.col("city") != "") & F.col("street").endswith(F.col("city")) & (F.length("street") > F.length("city"))
    filled = filled.withColumn("street", F.when(tail, F.expr("left(street, length(street) - length(city))")).otherwise(F.col("street")))
    filled = looked_up(filled, streets, "street", "_s").withColumn("street", F.coalesce("_s", "street"))
    rows, rows_path = materialize(filled.select(*parts.columns), "streets")
    if stages is not None:
        stages += [path, rows_path]
    located = (F.col("number") != "") & (F.col("city") != "")
    block = F.concat_ws("|", "city", "number", "street")
    # at most one entry per direction and type, however many rows
    known = rows.where(located & ((F.col("direction") != "") | (F.col("type") != ""))).groupBy(block.alias("_k")).agg(F.collect_set(F.struct("direction", "type")).alias("_known"))
    spread = F.when(located, block).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("row_id", "city", "zip"), F.lit(997))))
    j = (rows if keep_unlocated else rows.where(located)).withColumn("_k", spread).join(known, "_k", "left").drop("_k")

    def only(want: str, given: str) -> Column:
        """The one value of ``want`` among the block's variants that agree in ``given``."""
        agree = F.filter("_known", lambda v: (v[want] != "") & ((v[given] == F.col(given)) | (v[given] == "") | (F.col(given) == "")))
        found = F.array_distinct(F.transform(agree, lambda v: v[want]))
        return F.when((F.col(want) == "") & (F.size(found) == 1), found[0]).otherwise(F.col(want))

    j = j.withColumn("_d", only("direction", "type")).withColumn("_t", only("type", "direction"))
    key = F.concat_ws("|", "city", "number", "_d", "street", "_t", "unit")
    return j.select("*", F.when(located, key).alias("location")).drop("_known", "direction", "type").withColumnsRenamed({"_d": "direction", "_t": "type"})


def same_location_pairs(located: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two rows at one location."""
    ids = located.where("location IS NOT NULL AND row_id IS NOT NULL").select("location", "row_id").distinct()
    a, b = ids.withColumnRenamed("row_id", "id_a"), ids.withColumnRenamed("row_id", "id_b")
    return a.join(b, "location").where("id_a < id_b").select("id_a", "id_b")


def location_classes(located: DataFrame) -> DataFrame:
    """(row_id, location_id, ...): each located row with its class, named by the smallest id at the location."""
    least = located.groupBy("location").agg(F.min("row_id").alias("location_id"), F.count("*").alias("rows_here"))
    return located.join(least, "location").select("row_id", "location_id", "rows_here", "number", "direction", "street", "type", "unit", "city")
