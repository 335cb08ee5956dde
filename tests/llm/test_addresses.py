import pytest

from placeloom.llm import addresses as ad

COLS = ("address", "city", "state", "postal_code")


@pytest.mark.parametrize(
    "row, want",
    [
        (("4712 N Almondhaven Ave #B", "Pt Calder", "UT", "37856"), ("4712", "almondhaven", "north", "avenue", "b", "pt.calder", "ut", "37856")),
        (("Thyme Way, 7683, Port Calder, 37856", None, None, None), ("7683", "thyme", "", "way", "", "portcalder", "", "37856")),
        (("STE #102 8859 PELMORFIELD AVE LARCHVILLE GA 90293", "Larchville", "Georgia", None), ("8859", "pelmorfield", "", "avenue", "102", "larchville", "ga", "90293")),
        (("7943 E. St Belisa St (2nd floor) - Fort Hadley, CA", "Ft Hadley", "CA", "1234"), ("7943", "saintbelisa", "east", "street", "", "forthadley", "ca", "01234")),
        (("Tarnville 14238, 7021 14th Ct", "Tarnville", "OH", None), ("7021", "14th", "", "court", "", "tarnville", "oh", "14238")),
        (("9974 Eleventh Court", "x", None, None), ("9974", "11th", "", "court", "", "x", "", "")),
        (("1156 BRISKFIELD STR N SAINT OVANNE UT 87800-1404", "Saint Ovanne", "UT", None), ("1156", "briskfield", "north", "street", "", "saintovanne", "ut", "87800")),
        (("address on request", "Port Calder", "UT", "37879"), ("", "", "", "", "", "portcalder", "ut", "37879")),
        ((None, None, None, None), ("",) * 8),
        (("", "", "", ""), ("",) * 8),
    ],
)
def test_parse(row, want):
    assert ad.parse(*row) == want


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "id long, address string, city string, state string, postal_code string, street string")
    from placeloom.session import materialize

    parts, _ = materialize(ad.parsed(df, "id", *COLS), "t")
    return ad.canonical(parts)


def test_pairs_rules(spark):
    base = ("100 N Briskfield St", "Port Calder", "UT", "37800")
    rows = [base, base, ("Briskfield Street, 100, Port Calder, 37800", None, None, None), ("100 North Briskfeild Str", "PORT CALDER", None, None), ("100 Briskfield", "Port Caldr", None, "37800"),
            ("100 S Other Rd", "Port Calder", None, None), ("100 N Other Rd", "Port Calder", None, None), ("100 Other Rd", "Port Calder", None, None), ("101 N Briskfield St", "Port Calder", None, None),
            ("100 N Briskfield St #4", "Port Calder", None, None), ("100 N Briskfield St Unit 4", None, None, "37800"), (None, None, None, None), ("x " * 3000, "Port Calder", None, None)]
    got = {(r.id_a, r.id_b) for r in ad.same_location_pairs(run(spark, rows)).collect()}
    same = [0, 1, 2, 3, 4]
    assert got == {(a, b) for a in same for b in same if a < b} | {(9, 10)}


def test_empty(spark):
    assert ad.same_location_pairs(run(spark, [])).count() == 0


def test_edits():
    assert ad.edits("quillstead", "quilsltead", 2) == 1 and ad.edits("abc", "abcd", 2) == 1 and ad.edits("abc", "xyz", 2) == 3


def test_cities_and_types_of_other_places(spark):
    for a, b in [("N. Hollywood", "North Hollywood"), ("W. Covina", "West Covina"), ("So. Bend", "South Bend"), ("Ft. Worth", "Fort Worth"), ("Palm Bch", "Palm Beach")]:
        assert set(ad.expansions(ad.city_key(a))) & set(ad.expansions(ad.city_key(b)))
    assert ad.parse("12 Shady Cv", "x")[3] == "cove" and ad.parse("7 Santa Monica Fwy", "x")[3] == "freeway" and ad.parse("9 Sunset Park Blvd", "x")[1:4] == ("sunsetpark", "", "boulevard")
    assert ad.parse("9 Lincoln Pk Austin", "Austin")[1:6] == ad.parse("9 Lincoln Park", "Austin")[1:6] == ("lincolnpark", "", "", "", "austin") and ad.parse("9 Bull Run Rd", "x")[1:4] == ("bullrun", "", "road") and ad.parse("5 River Rd N", "x")[1:4] == ("river", "north", "road")
    full = ("100 Oak St", "North Hollywood", "CA", None), ("100 Oak St", "New Hesterly", "UT", None)
    rows = [*full, ("100 Oak St", "N. Hollywood", "CA", None), ("100 Oak Street", "N Hesterly", "UT", None), ("100 Oak St", "W. Covina", "CA", None), ("100 Oak St", "West Covina", "CA", None)]
    assert {(r.id_a, r.id_b) for r in ad.same_location_pairs(run(spark, rows)).collect()} == {(0, 2), (1, 3), (4, 5)}
