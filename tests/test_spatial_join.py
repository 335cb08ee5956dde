import math
import random

import numpy as np
import pytest

from placeloom.operators import spatial_join as sj


def brute(points, regions):
    out = set()
    for p, la, ln in points:
        for r, ca, cn, km in regions:
            if None in (p, r, la, ln, ca, cn, km) or km < 0 or any(map(math.isnan, (la, ln, km))) or not (-90 <= la <= 90 and -180 <= ln <= 180):
                continue
            if float(sj.great_circle_km(np.float64(la), np.float64(ln), np.float64(ca), np.float64(cn))) <= km:
                out.add((p, r))
    return out


def cases(seed):
    rng = random.Random(seed)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(1000 + i, 43.0 + rng.gauss(0, 0.05), -114.0 + rng.gauss(0, 0.05)) for i in range(400)]
    points += [(2000 + i, 60.0 + rng.uniform(-1, 1), rng.choice([-179.9, 179.9, 180.0, -180.0])) for i in range(60)] + [(3000 + i, rng.choice([89.9, -89.95, 90.0]), rng.uniform(-180, 180)) for i in range(40)]
    points += [(4001, None, 1.0), (4002, 91.0, 0.0), (4003, 0.0, 200.0), (4004, float("nan"), 0.0), (None, 43.0, -114.0), (4005, 43.0, -114.0), (4005, 43.0, -114.0)]
    regions = [(f"r{i}", rng.uniform(-85, 85), rng.uniform(-180, 180), rng.uniform(1, 900)) for i in range(60)] + [(f"h{i}", 43.0 + rng.gauss(0, 0.05), -114.0 + rng.gauss(0, 0.05), rng.uniform(0.5, 8)) for i in range(50)]
    regions += [("date", 60.0, 179.95, 80.0), ("west", 60.5, -179.99, 50.0), ("pole", 89.5, 10.0, 200.0), ("all", 0.0, 0.0, 30000.0), ("none", 1.0, 1.0, None), ("minus", 43.0, -114.0, -1.0), (None, 43.0, -114.0, 5.0), ("zero", 43.0, -114.0, 0.0)]
    return points, regions


@pytest.mark.parametrize("seed, leaf_rows, leaf_regions", [(1, 100_000, 20_000), (2, 40, 7), (3, 150, 20_000)])
def test_equals_brute_force(spark, seed, leaf_rows, leaf_regions):
    points, regions = cases(seed)
    p = spark.createDataFrame([(*x, "clash") for x in points], "fix_id long, lat double, lng double, radius_km string")
    r = spark.createDataFrame(regions, "zip string, lat double, lng double, radius_km double")
    rows = sj.within_circles(p, "fix_id", "lat", "lng", r, "zip", "lat", "lng", "radius_km", leaf_rows=leaf_rows, leaf_regions=leaf_regions).collect()
    assert {(x.fix_id, x.zip) for x in rows} == brute(points, regions)
    assert len(rows) == len({(x.fix_id, x.zip) for x in rows}) + len([1 for x in rows if x.fix_id == 4005]) // 2


def test_empty(spark):
    p = spark.createDataFrame([], "fix_id long, lat double, lng double")
    r = spark.createDataFrame([("a", 1.0, 1.0, 5.0)], "zip string, lat double, lng double, radius_km double")
    assert sj.within_circles(p, "fix_id", "lat", "lng", r, "zip", "lat", "lng", "radius_km").count() == 0
    assert sj.within_circles(r, "zip", "lat", "lng", r.limit(0), "zip", "lat", "lng", "radius_km").count() == 0


def test_tree_covers_the_plane():
    rng = np.random.default_rng(0)
    la, ln = rng.uniform(-90, 90, 4000), rng.uniform(-180, 180, 4000)
    tree = sj.build_tree(la, ln, 10.0, 500)
    k, box = tree.leaf_of(la, ln), tree.boxes()
    assert ((box[k, 0] <= la) & (la <= box[k, 1]) & (box[k, 2] <= ln) & (ln <= box[k, 3])).all()
    assert abs(((box[:, 1] - box[:, 0]) * (box[:, 3] - box[:, 2])).sum() - 180 * 360) < 1e-6
