import random

from placeloom.llm.components import hash_to_min


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "id_a long, id_b long, v long, u long, m long")
    return {r.id: r.group_id for r in hash_to_min(df, "id_a", "id_b").collect()}


def test_random_chains_stars_and_dirt(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 260)] + [(5, 1000 + i) for i in range(60)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    pairs += [(7, 7), (None, 8), (9, None), (None, None), (101, 100), (101, 100)]
    rng.shuffle(pairs)
    assert run(spark, [(a, b, 1, 2, 3) for a, b in pairs]) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {}


def test_one_giant_component(spark):
    """A star, a long chain and a tree in one, with sizes at which adaptive plans split the join on the smallest vertex."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    rng = random.Random(9)
    pairs = [(i, rng.randrange(max(0, i - 3), i)) for i in range(1, 4000)] + [(0, 10_000 + i) for i in range(3000)] + [(50_000, 50_001)]
    df = spark.createDataFrame(pairs, "id_a long, id_b long")
    want = brute(pairs)
    assert {r.id: r.group_id for r in hash_to_min(df, "id_a", "id_b").collect()} == want
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert set(want.values()) == {0, 50_000}
