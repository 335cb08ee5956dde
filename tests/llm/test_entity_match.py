import random

import numpy as np
from pyspark.sql import functions as F

from placeloom.llm import entity_match as em


def test_names():
    assert em.name_parts("The Rusty Anchor Ktchn (Downtown) #3") == em.name_parts("Anchor, Rusty Kitchen LLC")
    assert em.name_parts("Blue Oven Cafe - Port Calder") == ("blue oven", "cafe")
    assert em.name_parts('""') == em.name_parts("n/a") == em.name_parts(None) == em.name_parts("$1.50 tacos") == ("", "")
    assert em.name_likeness("blue oven", "cafe", "blue ovn", "") > 0.8 and em.name_likeness("", "", "x", "") == -1
    assert em.name_likeness("blue oven", "cafe", "hollow mill", "deli") == 0


R = "id long, name string, address string, city string, state string, postal_code string, phone string, latitude double, longitude double, src string"
P = "id string, name string, street string, city string, region string, postcode string, phones array<string>, lat double, lng double"


def tables(spark, n=150):
    rng = random.Random(4)
    heads, mids, kinds = ["Blue", "Rusty", "Hollow", "Amber", "Quiet", "Velvet"], ["Anchor", "Barrel", "Crane", "Heron", "Kettle", "Lotus", "Marlin"], ["Cafe", "Deli", "Grill"]
    left, right = [], []
    for i in range(n):
        name = f"{rng.choice(heads)} {rng.choice(mids)} {rng.choice(kinds)}"
        num, zip5, phone = 100 + i // 2, f"{30000 + i // 20}", f"{rng.randrange(10**9, 10**10)}"
        street = ["Oakmoor St", "Elmfield Ave", "Birchdale Rd"][i % 3]
        left.append((i, name, f"{num} {street}", "Port Calder", "UT", zip5, phone, 40 + i / 50, -100.0, "x"))
        right.append((f"p{i}", name.replace("Cafe", "Café").upper() if i % 3 else f"The {name}", f"{street}, {num}, Port Calder", "port calder", None, zip5, [phone] if i % 4 else None, 40 + i / 50, -100.0))
    left += [(n, None, None, None, None, None, None, None, None, "x"), (0, *left[0][1:]), (n + 1, "", "", "", "", "", "", 0.0, 0.0, "x")]
    right += [("q", None, None, None, None, None, [], None, None), (None, "x", None, None, None, None, None, None, None)]
    return spark.createDataFrame(left, R), spark.createDataFrame(right, P), n


def test_finds_the_same_venues(spark):
    left, right, n = tables(spark)
    got = em.match_venues(left, right).where("posterior >= 0.5").collect()
    pairs = {(r.restaurant_id, r.place_id) for r in got}
    assert len(got) == len(pairs)
    true = {(i, f"p{i}") for i in range(n)}
    assert len(pairs & true) >= 0.97 * n and len(pairs - true) <= 0.03 * n


def test_empty(spark):
    left, right, _ = tables(spark, 2)
    assert em.match_venues(left.limit(0), right.limit(0)).count() == 0


def test_transitive_repairs(spark):
    df = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.98), ("a", "c", 0.4), ("x", "y", 0.6), ("y", "z", 0.9), ("x", "z", 0.001)], "a string, b string, gamma double").selectExpr("*", "7 AS v", "false AS low")
    got = {(r.a, r.b): r.gamma for r in em.transitive(df).collect()}
    assert abs(got["a", "c"] - 0.99 * 0.98) < 1e-9 and abs(got["x", "y"] - 0.001 / 0.9) < 1e-9 and got["y", "z"] == 0.9


def test_vectors_have_one_number(spark):
    rows = [(-1, 0, 20, 7, -1), (20, 20, 20, 20, 20), (-1, -1, -1, -1, -1)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in em.FEATURES)).withColumn("v", em.code([F.col(f) for f in em.FEATURES]))
    got = df.select("v", *[em.feature(f).cast("int").alias(f) for f in em.FEATURES]).collect()
    assert [tuple(r)[1:] for r in got] == rows and em.decoded(np.array([r.v for r in got])).tolist() == [list(map(float, r)) for r in rows]


def test_rows_without_address_meet_near_spellings(spark):
    rows = [
        # a lost row and a partner without ZIP, with its ZIP transposed, with a letter wrong; then another venue
        ("a", None, "port calder", "", "", "comet humble", "30412", []), ("b", "x", "port calder", "1", "oak", "comet humble", "", []), ("c", "y", "port calder", "2", "oak", "comet humble", "30421", []),
        ("d", "z", "port calder", "3", "oak", "comet hunble", "30412", []), ("e", None, "port calder", "", "", "cmet humble", "", []), ("f", "w", "port calder", "4", "oak", "lotus velvet", "30412", []),
    ]
    p = spark.createDataFrame(rows, "pid string, location string, city string, number string, street string, core string, zip string, phones array<string>")
    got = {(r.pa, r.pb) for r in em.candidates(p).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "e"), ("c", "e"), ("d", "e")}


def test_third_sides_become_candidates(spark):
    rows = [
        ("a", "l", None, "", "", "", "30412", ["5550001111"]), ("b", "l", "port calder|1|oak", "port calder", "1", "oak", "30412", ["5550001111"]),
        ("c", "r", "port calder|1|oak", "port calder", "1", "oak", "", []), ("d", "r", "port calder|2|oak", "port calder", "2", "oak", "", []),
    ]
    schema = "pid string, src string, location string, city string, number string, street string, zip string, phones array<string>, direction string, type string, unit string, core string, kinds string, lat double, lng double"
    p = spark.createDataFrame([(*r, "", "", "", "comet humble", "", None, None) for r in rows], schema)
    pairs = em.vectors(em.candidates(p), p)
    ids = lambda df: {(r.a, r.b) for r in df.select("a", "b").collect()}
    assert ids(pairs) == {("a", "b"), ("b", "c")} and ids(em.closed(pairs, p)) == {("a", "b"), ("b", "c"), ("a", "c")}


def test_repairs_go_on_until_stable(spark):
    chain = [("a", "b", 0.99), ("b", "c", 0.99), ("c", "d", 0.99), ("a", "c", 0.6), ("b", "d", 0.6), ("a", "d", 0.5)]
    got = {(r.a, r.b): r.gamma for r in em.settled(spark.createDataFrame(chain, "a string, b string, gamma double").selectExpr("*", "7 AS v")).collect()}
    assert abs(got["a", "d"] - 0.99**3) < 1e-6 and len(got) == 6


def test_like_names_share_a_key_and_single_words_do_not(spark):
    rng = random.Random(11)
    words = ["oak", "blue", "crane", "humble", "lantern", "smokehill", "brunnick", "otter", "iron", "meridian"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]])

    names = []
    for _ in range(300):
        a = rng.sample(words, rng.choice([1, 2, 2, 3]))
        b = [typo(w) if rng.random() < 0.4 else w for w in a] + rng.sample(words, rng.choice([0, 0, 1]))
        names.append((" ".join(sorted(a)), " ".join(sorted(b[: rng.choice([len(b), 3])]))))
    pairs = spark.createDataFrame(names, "a string, b string")
    asked, held = em.name_keys(F.col("a"))[0], em.name_keys(F.col("b"))[1]
    for r in pairs.select("a", "b", F.arrays_overlap(asked, held).alias("met")).collect():
        assert r.met or em.name_likeness(r.a, "", r.b, "") < 0.7, r
    # one common word of two, as a thousand venues of a ZIP may have, is no candidate
    row = lambda i, core, at: (i, at, "port calder", "1", "oak", core, "30412", [])
    rows = [row("a", "comet humble", None), *[row(f"b{i}", f"comet {w}", f"x{i}") for i, w in enumerate(["lotus", "velvet", "anchor"])]]
    p = spark.createDataFrame(rows, "pid string, location string, city string, number string, street string, core string, zip string, phones array<string>")
    assert not [r for r in em.candidates(p).collect() if "a" in (r.pa, r.pb)]


def test_ids_behind_several_profiles_give_a_pair_once(spark):
    left, right, n = tables(spark)
    again = left.where("id < 40").withColumn("phone", F.lit(None).cast("string"))
    got = em.match_venues(left.unionByName(again), right, least=0.5).collect()
    pairs = {(r.restaurant_id, r.place_id) for r in got}
    assert len(got) == len(pairs) and len(pairs & {(i, f"p{i}") for i in range(n)}) >= 0.97 * n
