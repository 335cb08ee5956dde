import random

import pytest

from placeloom.llm.topn import top_n_per_group, top_venues


@pytest.mark.parametrize("heavy", [5, 10_000])
def test_equals_brute_force(spark, heavy):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1.0, 2.0, 2.0]), "x") for i in range(400)] + [("solo", 999, None, "x")]
    df = spark.createDataFrame(rows, "g string, id long, s double, count string")
    got = {(r.g, r.id, r["_rank"]) for r in top_n_per_group(df, ["g"], "s", "id", 3, heavy).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:3]
        want |= {(g, r[1], k) for k, r in enumerate(best, 1)}
    assert got == want


def test_venues_repeats_and_blanks(spark):
    r = spark.createDataFrame([(1, " Town ", 0.5), (2, "TOWN", 0.5), (3, "", 0.9), (4, None, 0.9), (5, "town", None)], "id long, city string, popularity_score double")
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (5, 11), (None, 10)], "restaurant_id long, cuisine_id long")
    c = spark.createDataFrame([(10, "thai", "x"), (11, None, "y")], "id long, slug string, city string")
    got = [(x.city, x.slug, x.restaurant_id, x["_rank"]) for x in top_venues(r, links, c).collect()]
    assert sorted(got) == [("town", "thai", 1, 1), ("town", "thai", 2, 2), ("town", "thai", 5, 3)]
    assert top_venues(r.limit(0), links, c).count() == 0
