"""Opening hours as written on maps, as spans of minutes since the day's midnight."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["mo", "tu", "we", "th", "fr", "sa", "su"]
SPAN = re.compile(r"(\d{1,2}):(\d\d)\s*-\s*(\d{1,2}):(\d\d)")


def parse_days(s: str) -> list[int] | None:
    """Day numbers (Monday is 0) of 'Mo-Fr,Su'; ranges may wrap round the week; holidays are skipped; None if it is no list of days."""
    out: list[int] = []
    for part in filter(None, re.split(r"\s*,\s*", s.strip().lower())):
        if part in ("ph", "sh"):
            continue
        m = re.fullmatch(r"([a-z]{2})(?:\s*-\s*([a-z]{2}))?", part)
        if not m or m[1] not in DAYS or (m[2] and m[2] not in DAYS):
            return None
        a, b = DAYS.index(m[1]), DAYS.index(m[2] or m[1])
        out += [d % 7 for d in range(a, b + 1 if b >= a else b + 8)]
    return out


def parse_hours(s: str | None) -> list[tuple[int, int, int]] | None:
    """[(day, open, close)] in order; close may pass 1440 where a day ends after midnight; None if it cannot be read.

    Rules stand between semicolons and later ones replace earlier ones on their days; 'off' closes them.
    """
    if not s or not s.strip():
        return None
    if s.strip() == "24/7":
        return [(d, 0, 1440) for d in range(7)]
    week: dict[int, list[tuple[int, int]]] = {}
    for rule in filter(None, (r.strip() for r in s.split(";"))):
        m = re.match(r"(?i)((?:[a-z]{2}(?:\s*-\s*[a-z]{2})?\s*,?\s*)*)(.*)$", rule)
        head, rest = (m[1].strip(" ,"), m[2].strip()) if m else ("", rule)
        if head.lower().endswith("of") and rest.lower() == "f":
            head, rest = head[:-2].strip(" ,"), "off"
        days = parse_days(head) if head else list(range(7))
        if days is None:
            return None
        if rest.lower() in ("off", "closed"):
            spans: list[tuple[int, int]] = []
        else:
            parts = [SPAN.fullmatch(p.strip()) for p in rest.split(",")]
            if not rest or not all(parts):
                return None
            spans = []
            for p in parts:
                a, b = int(p[1]) * 60 + int(p[2]), int(p[3]) * 60 + int(p[4])
                if a > 1440 or b > 2880:
                    return None
                spans.append((a, b + 1440 if b <= a else b))
        for d in days:
            week[d] = spans
    return [(d, a, b) for d in sorted(week) for a, b in week[d]]


def clock(minutes: int) -> str:
    """Twelve-hour form: 0 is '12:00 AM', 1470 is '12:30 AM'."""
    h, m = divmod(minutes % 1440, 60)
    return f"{h % 12 or 12}:{m:02d} {'AM' if h < 12 else 'PM'}"


def hours(text: Column) -> Column:
    """array<struct<day, open, close>>; null where the text cannot be read."""

    @F.pandas_udf("array<struct<day:int,open:int,close:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([None if (p := parse_hours(x if isinstance(x, str) else None)) is None else [dict(zip(("day", "open", "close"), y)) for y in p] for x in t], dtype=object)

    return run(text)


# Names of days.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def listed_hours(hours: Column) -> Column:
    """array<struct<day, open, close>> of a map from day names to ranges ("11 AM-9 PM"), in order of the week.

    Days that are closed, have several ranges, no digits on a side or no dash are left out; an opening without AM or PM
    takes that of the close. Null where no day is left. Keys are read in any case and with outer spaces.
    """
    keys = F.transform(F.map_entries(hours), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.trim(e["value"]).alias("v")))
    # one range has one dash of some sort, and none of the marks that divide ranges
    sides = lambda v: F.split(F.translate(v, "\u2013\u2014", "--"), r"\s*-\s*")

    def row(name: str) -> Column:
        value = F.get(F.filter(keys, lambda e: e["k"] == name.lower()), 0)["v"]
        part = sides(value)
        left, right = F.get(part, 0), F.array_join(F.slice(part, F.lit(2), F.greatest(F.lit(1), F.size(part))), "-")
        half = F.upper(F.right(right, F.lit(2)))
        opening = F.when(~F.upper(left).rlike("(AM|PM)$") & half.isin("AM", "PM"), F.concat(left, F.lit(" "), half)).otherwise(left)
        good = value.isNotNull() & ~F.contains(value, F.lit(",")) & (F.size(part) >= 2) & left.rlike("[0-9]") & right.rlike("[0-9]")
        return F.when(F.coalesce(good, F.lit(False)), F.struct(F.lit(name).alias("day"), opening.alias("open"), right.alias("close")))

    found = F.array_compact(F.array(*[row(n) for n in DAY_NAMES]))
    return F.when(F.size(found) > 0, found)


def linked_hours(objects: list[dict]) -> list[tuple[str, str, str]]:
    """(day, opens, closes) of linked data: ``openingHoursSpecification`` objects, else ``openingHours`` texts."""
    out: list[tuple[str, str, str]] = []
    for o in objects:
        spec = o.get("openingHoursSpecification")
        for s in spec if isinstance(spec, list) else [spec] if isinstance(spec, dict) else []:
            if not isinstance(s, dict) or not s.get("opens") or not s.get("closes"):
                continue
            days = s.get("dayOfWeek")
            for d in days if isinstance(days, list) else [days]:
                name = str(d or "").rstrip("/").rpartition("/")[2].capitalize()
                if name in DAY_NAMES:
                    out.append((name, str(s["opens"])[:5], str(s["closes"])[:5]))
    if not out:
        for o in objects:
            texts = o.get("openingHours")
            for t in texts if isinstance(texts, list) else [texts]:
                for d, a, b in parse_hours(t if isinstance(t, str) else None) or []:
                    out.append((DAY_NAMES[d], f"{a // 60:02d}:{a % 60:02d}", f"{b % 1440 // 60:02d}:{b % 60:02d}"))
    return sorted(set(out), key=lambda x: (DAY_NAMES.index(x[0]), x[1:]))
