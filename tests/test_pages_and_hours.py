import pytest
from pyspark.sql import functions as F

from placeloom.functions import hours as h
from placeloom.functions import html


@pytest.mark.parametrize(
    "text, want",
    [
        ("24/7", [(d, 0, 1440) for d in range(7)]),
        ("Mo-We 09:00-17:00; Tu off", [(0, 540, 1020), (2, 540, 1020)]),
        ("Sa-Mo 22:00-02:00", [(0, 1320, 1560), (5, 1320, 1560), (6, 1320, 1560)]),
        ("Fr 11:00-14:00,17:00-22:00", [(4, 660, 840), (4, 1020, 1320)]),
        ("10:00-12:00; PH off", [(d, 600, 720) for d in range(7)]),
        ("open most days", None), ("", None), (None, None), ("Mo 9-5", None),
    ],
)
def test_hours(text, want):
    assert h.parse_hours(text) == want


def test_clock_and_column(spark):
    assert [h.clock(x) for x in (0, 720, 1470, 779)] == ["12:00 AM", "12:00 PM", "12:30 AM", "12:59 PM"]
    df = spark.createDataFrame([("Mo 09:00-10:00",), (None,), ("x",)], "t string")
    assert [r[0] and len(r[0]) for r in df.select(h.hours(F.col("t"))).collect()] == [1, None, None]


PAGE = """<html><head><title> Blue  Oven </title><meta property="og:site_name" content="Blue Oven Cafe"><script>var x = "no";</script>
<script type="application/ld+json">{"@graph": [{"name": "Blue Oven Cafe", "telephone": "+1 (555) 123-4567", "sameAs": ["https://www.instagram.com/blueoven/?hl=en"]}]}</script></head>
<body><p>Find us at 412 Oak St, Port Calder.</p><a href="https://facebook.com/sharer?u=1">s</a><a href="https://m.facebook.com/blueoven/about">f</a><a href="tel:5551234567">c</a></body></html>"""


def test_evidence_and_verdict(spark):
    e = html.evidence(PAGE)
    assert e["title"] == "Blue Oven" and e["phones"] == ["5551234567"] and e["names"] == ["Blue Oven Cafe"]
    assert e["profiles"] == ["https://facebook.com/blueoven", "https://instagram.com/blueoven"] and "var x" not in e["text"] and "412 Oak St" in e["text"]
    rows = [(PAGE, "Blue Oven Cafe", None, "Port Calder", "412"), (PAGE, "x", "(555) 123 4567", None, None), (PAGE, "Blue Oven", None, "Elsewhere", "9"), (PAGE, "Other", None, None, None), (None, "a", None, None, None)]
    df = spark.createDataFrame(rows, "page string, name string, phone string, city string, no string").withColumn("e", html.page_evidence(F.col("page")))
    got = [r[0] for r in df.select(html.verdict(F.col("e"), F.col("name"), F.col("phone"), F.col("city"), F.col("no"))).collect()]
    assert got == ["verified", "verified", "brand", "unconfirmed", "unreachable"]


def test_sanitizer():
    assert html.sanitized('<p onclick="x">a <b>gone</b><strong>kept</strong></p><script>bad()</script><a href="javascript:x" title="t">l</a>&lt;') == '<p>a <strong>kept</strong></p><a title="t">l</a>&lt;'
    assert html.sanitized(None) is None and html.sanitized("") == ""


def test_profiles_and_robots():
    assert html.profile("twitter.com/someone?x=1") == ("x", "https://twitter.com/someone") and html.profile("https://instagram.com/p/abc") is None and html.profile(None) is None and html.profile("http://[bad") is None
    rules = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$"
    assert html.robots_allow(rules, "/") and not html.robots_allow(rules, "/private/x") and html.robots_allow(rules, "/private/open/y") and not html.robots_allow(rules, "/a/b.pdf")
