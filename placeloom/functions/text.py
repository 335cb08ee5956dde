"""Text keys, address parts and URL parts as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what they are folded to.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# States and territories with their codes, country names that may end an address, words of names that stay small.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "guam": "GU", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
COUNTRY = ["US", "USA", "UNITED STATES"]
SMALL_WORDS = ["of", "the", "and", "at", "in", "on", "de", "la", "del"]
CODES = sorted(set(STATES.values()))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def last_ten_digits(phone: Column) -> Column:
    d = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def state_code(state: Column) -> Column:
    """The two-letter code of a state's code or name in any case; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return let(F.trim(state), lambda t: F.when(F.upper(t).isin(CODES), F.upper(t)).otherwise(F.try_element_at(names, F.lower(t))))


def address_parts(address: Column) -> Column:
    """What stands between the commas of an address, in order; blanks and a country at the end are left out."""
    named = lambda x: F.upper(F.replace(x, F.lit("."), F.lit(""))).isin(COUNTRY)
    whole = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    shorter = lambda x: F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - 1))

    def without_country(p: Column) -> Column:
        last = F.try_element_at(p, F.lit(-1))
        # "UT 84101 USA": the country is a word of the last part
        return F.when(F.coalesce(named(last), F.lit(False)), shorter(p)).when(
            F.size(p) > 0, let(F.split(last, r"\s+"), lambda w: F.when((F.size(w) > 1) & named(F.element_at(w, -1)), F.concat(shorter(p), F.array(F.array_join(shorter(w), " ")))).otherwise(p))).otherwise(p)

    return let(whole, without_country)


def is_zip(c: Column) -> Column:
    """Five digits, or nine with a hyphen."""
    return F.coalesce(c.rlike("^[0-9]{5}(-[0-9]{4})?$"), F.lit(False))


def zip_of(address: Column, postal: Column) -> Column:
    """The ZIP that is the address's last word, else the postal code's.

    In "street, number" the number is a house's even if it has five digits: a last part that is all number, after a
    single part that begins with none, is no ZIP.
    """
    def read(p: Column) -> Column:
        def last_word(w: Column) -> Column:
            house = (F.size(p) == 2) & (F.size(w) == 1) & ~F.left(F.try_element_at(p, F.lit(1)), F.lit(1)).between("0", "9")
            return F.when(is_zip(F.element_at(w, -1)) & ~F.coalesce(house, F.lit(False)), F.left(F.element_at(w, -1), F.lit(5)))

        return F.when(F.size(p) > 0, let(F.split(F.try_element_at(p, F.lit(-1)), r"\s+"), last_word))

    own = F.trim(postal)
    return F.coalesce(let(address_parts(address), read), F.when(is_zip(own), F.left(own, F.lit(5))))


def city_state_of(address: Column) -> Column:
    """struct(city, state) that an address names between commas.

    Three shapes are read: city before a state with its ZIP (the state alone needs a third part and must exist), city
    before a ZIP, and street, house number, city. A city has two letters or more, only letters, spaces, stops,
    hyphens and apostrophes, and begins with a letter.
    """
    def read(p: Column) -> Column:
        n, last = F.size(p), F.try_element_at(p, F.lit(-1))

        def shapes(w: Column) -> Column:
            head, tail = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(2))
            letters = F.coalesce((F.length(head) == 2) & (F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") == ""), F.lit(False))
            known = letters & head.isin(CODES)
            by_state = letters & (((F.size(w) == 2) & is_zip(tail) & (n >= 2)) | ((F.size(w) == 1) & known & (n >= 3)))
            by_zip = (F.size(w) == 1) & is_zip(head) & (n >= 3)
            by_number = (n == 3) & F.coalesce(F.translate(F.try_element_at(p, F.lit(2)), "0123456789", "") == "", F.lit(False))
            city = F.when(by_state | by_zip, F.try_element_at(p, F.lit(-2))).when(by_number, last)
            bare = F.translate(F.lower(city), "abcdefghijklmnopqrstuvwxyz .'-", "")
            good = (bare == "") & (F.length(city) >= 2) & F.lower(F.left(city, F.lit(1))).between("a", "z")
            return F.struct(F.when(good, city).alias("city"), F.when(good & by_state & known, head).alias("state"))

        return let(F.split(F.coalesce(last, F.lit("")), r"\s+"), shapes)

    return let(address_parts(address), read)


def title_case(c: Column) -> Column:
    """Single spaces, each word with a capital; small words after the first stay small. Null and blank give null."""
    words = F.split(F.lower(collapsed(c)), " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))))
    return F.when(~blank(c), F.array_join(cased, " "))


def place_key(name: Column) -> Column:
    """Lower case, no accents or marks, with saint, mount and fort shortened."""
    n = folded(name)
    for long, short in (("saint", "st"), ("mount", "mt"), ("fort", "ft")):
        n = F.regexp_replace(n, rf"\b{long}\b", short)
    return F.trim(F.regexp_replace(n, "[^a-z0-9]+", " "))


def name_key(name: Column) -> Column:
    """Letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""), " +", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1), r"(?i)^www\.", ""))


def blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return F.coalesce(F.trim(c) == "", F.lit(True))
