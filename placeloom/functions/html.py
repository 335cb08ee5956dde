"""What a web page says about a venue: title, text, phones, profiles, linked data; and a sanitizer."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions.hours import DAY_NAMES, linked_hours, parse_hours

HIDDEN = {"script", "style", "noscript", "template", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link"}
ALLOWED = {"p": set(), "br": set(), "strong": set(), "em": set(), "ul": set(), "ol": set(), "li": set(), "h2": set(), "h3": set(), "blockquote": set(), "a": {"href", "title"}}
# Profile hosts by platform.
PLATFORMS = {"facebook.com": "facebook", "instagram.com": "instagram", "x.com": "x", "twitter.com": "x", "tiktok.com": "tiktok", "youtube.com": "youtube"}
NOT_PROFILES = {"share", "sharer", "intent", "login", "home", "watch", "explore", "p", "reel", "hashtag", "search", "plugins", "tr"}


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.links, self.text, self.linked = "", {}, [], [], []
        self.times: list[str] = []
        self.stack: list[str] = []
        self.ld = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in VOID:
            self.stack.append(tag)
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a["name"], a.get("content", ""))
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        self.ld = tag == "script" and a.get("type", "").lower() == "application/ld+json"

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.ld and self.stack and self.stack[-1] == "script":
            self.linked.append(data)
        elif "title" in self.stack:
            self.title += data
        elif not HIDDEN.intersection(self.stack):
            self.text.append(data)


def nodes(value) -> Iterator[dict]:
    """Every object in a linked-data document, however deep."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from nodes(v)


def profile(url: str | None) -> tuple[str, str] | None:
    """(platform, canonical URL) of a profile; None for share links, posts and other sites."""
    try:
        u = urlsplit(url if "//" in (url or "") else f"https://{url}")
    except ValueError:
        return None
    host = re.sub(r"^(www|m|mobile)\.", "", (u.hostname or "").lower())
    parts = [p for p in u.path.split("/") if p]
    if host not in PLATFORMS or not parts or parts[0].lower() in NOT_PROFILES or parts[0].endswith(".php"):
        return None
    if host == "youtube.com" and parts[0] in ("channel", "c", "user"):
        return (PLATFORMS[host], f"https://{host}/{'/'.join(parts[:2])}") if len(parts) > 1 else None
    return PLATFORMS[host], f"https://{host}/{parts[0]}"


def evidence(page: str | None) -> dict | None:
    """title, site, phones, profiles, names (of linked data) and visible text; None for no page."""
    if not page:
        return None
    p = Page()
    p.feed(page)
    found, phones, names = {}, [], []
    objects = []
    for block in p.linked:
        try:
            objects += list(nodes(json.loads(block)))
        except ValueError:
            continue
    same = [u for o in objects for u in ([o["sameAs"]] if isinstance(o.get("sameAs"), str) else o.get("sameAs") or []) if isinstance(u, str)]
    for u in [*same, *p.links]:
        if x := profile(u):
            found.setdefault(*x)
    for o in objects:
        names += [o["name"]] if isinstance(o.get("name"), str) else []
        phones += [o["telephone"]] if isinstance(o.get("telephone"), str) else []
    phones += [u[4:] for u in p.links if u.lower().startswith("tel:")]
    tails = list(dict.fromkeys(d[-10:] for x in phones if len(d := re.sub(r"\D", "", x)) >= 10))
    return {"title": " ".join(p.title.split()), "site": p.meta.get("og:site_name", ""), "phones": tails, "profiles": [u for _, u in sorted(found.items())], "names": names, "text": " ".join(" ".join(p.text).split())}


def opening_hours(page: str | None) -> dict | None:
    """{"hours": [(day, open, close)], "raw": text}: from linked data, else times marked up in ``<time>``, else the first
    visible piece of 21 to 499 characters that speaks of opening and holds a clock time. None where nothing does."""
    if not page:
        return None
    p = Page()
    p.feed(page)
    objects = []
    for block in p.linked:
        try:
            objects += list(nodes(json.loads(block)))
        except ValueError:
            continue
    found = linked_hours(objects)
    if found:
        return {"hours": found, "raw": None}
    marked = [week for t in p.times if (week := parse_hours(t))]
    if marked:
        return {"hours": [(DAY_NAMES[d], f"{a // 60:02d}:{a % 60:02d}", f"{b % 1440 // 60:02d}:{b % 60:02d}") for week in marked for d, a, b in week], "raw": None}
    for piece in (" ".join(x.split()) for x in p.text):
        if 21 <= len(piece) <= 499 and re.search(r"(?i)\b(hours|open|closed)\b", piece) and re.search(r"\d{1,2}(:\d\d|\s*[ap]m)", piece, re.I):
            return {"hours": [], "raw": piece}
    return None


def page_hours(page: Column) -> Column:
    """struct(hours array<struct<day, open, close>>, raw) of :func:`opening_hours`; null without any."""

    @F.pandas_udf("hours array<struct<day:string,open:string,close:string>>, raw string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [opening_hours(x if isinstance(x, str) else None) for x in t]
            yield pd.DataFrame({"hours": [None if r is None else [dict(zip(("day", "open", "close"), h)) for h in r["hours"]] for r in rows], "raw": [None if r is None else r["raw"] for r in rows]})

    return run(page)


def sanitized_html(page: Column) -> Column:
    """Column form of :func:`sanitized`, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([sanitized(x if isinstance(x, str) else None) for x in t], dtype=object)

    return run(page)


def robots_allowed(rules: Column, path: Column) -> Column:
    """Column form of :func:`robots_allow` for any agent."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, p in batches:
            yield pd.Series([robots_allow(a or "", b or "/") for a, b in zip(r, p)], dtype=bool)

    return run(rules, path)


def profiles_of(urls: Column) -> Column:
    """array<string>: canonical profile URLs among ``urls``, sorted; see :func:`profile`."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([sorted({x[1] for u in us if (x := profile(u))}) if us is not None else [] for us in t], dtype=object)

    return run(urls)


def page_evidence(page: Column) -> Column:
    @F.pandas_udf("title string, site string, phones array<string>, profiles array<string>, names array<string>, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame([evidence(x if isinstance(x, str) else None) or dict.fromkeys(("title", "site", "phones", "profiles", "names", "text")) for x in t], columns=["title", "site", "phones", "profiles", "names", "text"])

    return run(page)


def verdict(e: Column, name: Column, phone: Column, city: Column, street_number: Column) -> Column:
    """'verified', 'brand', 'unconfirmed' or 'unreachable' for page evidence against what is known of a venue."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    head = squeeze(F.concat_ws(" ", e["title"], e["site"], F.array_join(e["names"], " ")))
    named = F.coalesce((F.length(squeeze(name)) > 2) & F.contains(head, squeeze(name)), F.lit(False))
    called = F.coalesce(F.array_contains(e["phones"], F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(10))), F.lit(False))
    placed = F.coalesce(F.contains(F.lower(e["text"]), F.lower(city)), F.lit(False)) & F.coalesce(F.rlike(e["text"], F.concat(F.lit(r"\b"), street_number, F.lit(r"\b"))), F.lit(False))
    return F.when(e["text"].isNull(), "unreachable").when(called | (named & placed), "verified").when(named, "brand").otherwise("unconfirmed")


class Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag not in ALLOWED:
            if tag not in VOID:
                self.skip.append(tag)
            return
        keep = [(k, v or "") for k, v in attrs if k in ALLOWED[tag] and not re.match(r"(?i)\s*(javascript|data|vbscript):", v or "")]
        self.out.append(f"<{tag}" + "".join(f' {k}="{entities.escape(v)}"' for k, v in keep) + ">")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
        elif tag in ALLOWED and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(entities.escape(data, quote=False))


def sanitized(page: str | None) -> str | None:
    """Only allowed elements and attributes; what is not allowed goes with all it holds."""
    if page is None:
        return None
    c = Cleaner()
    c.feed(page)
    c.close()
    return "".join(c.out)


def robots_allow(rules: str, path: str, agent: str = "*") -> bool:
    """Whether a robots file lets ``agent`` fetch ``path``: any matching Allow wins over any Disallow."""
    groups: list[tuple[set[str], list[tuple[str, str]]]] = []
    fresh = False
    for line in rules.splitlines():
        k, _, v = line.split("#")[0].partition(":")
        k, v = k.strip().lower(), v.strip()
        if k == "user-agent":
            if not fresh:
                groups.append((set(), []))
            groups[-1][0].add(v.lower())
            fresh = True
        elif k in ("allow", "disallow") and groups:
            groups[-1][1].append((k, v))
            fresh = False
    mine = [r for names, r in groups if agent.lower() in names] or [r for names, r in groups if "*" in names]
    hit = lambda p: bool(p) and re.match(re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path) is not None
    flat = [x for r in mine for x in r]
    return any(k == "allow" and hit(p) for k, p in flat) or not any(k == "disallow" and hit(p) for k, p in flat)
