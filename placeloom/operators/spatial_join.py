"""Points near other points or inside circular regions.

A bounded sample of the points drives a quadtree whose leaves hold about the same number of
points. Each point goes to the one leaf that holds it; each region is replicated to every leaf its
bounding box touches. Within a leaf the regions are bulk-loaded into an R-tree (sort-tile-recursive
packing), the points probe it in vectorised batches and survivors are refined with the exact
great-circle distance. A pair is reported by the leaf that holds its reference point, the point
itself, so replicated regions cause no duplicates. Leaves that stay heavy at the deepest level (many
points in one place) are salted, and leaves with many regions are cut into chunks of regions, so no
task ever gets an unbounded leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DEPTH = 20
FANOUT = 16


@dataclass
class QuadTree:
    """Leaves as ranges of Morton codes, with the salts and region chunks of each."""

    starts: np.ndarray
    depths: np.ndarray
    salts: np.ndarray

    def leaf_of(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(*unit(lat, lng)), side="right") - 1

    def boxes(self) -> np.ndarray:
        """min lat, max lat, min lng, max lng of each leaf."""
        x, y = unmorton(self.starts)
        side = 1 << (DEPTH - self.depths)
        scale = float(1 << DEPTH)
        return np.column_stack([y / scale * 180 - 90, (y + side) / scale * 180 - 90, x / scale * 360 - 180, (x + side) / scale * 360 - 180])


def unit(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = (1 << DEPTH) - 1
    scale = float(1 << DEPTH)
    x = np.clip(((np.asarray(lng, float) + 180) / 360 * scale).astype(np.int64), 0, top)
    y = np.clip(((np.asarray(lat, float) + 90) / 180 * scale).astype(np.int64), 0, top)
    return x, y


def morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for b in range(DEPTH):
        out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
    return out


def unmorton(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    for b in range(DEPTH):
        x |= ((code >> (2 * b)) & 1) << b
        y |= ((code >> (2 * b + 1)) & 1) << b
    return x, y


def build_tree(lat: np.ndarray, lng: np.ndarray, weight: float, leaf_rows: int, least_leaves: int = 32) -> QuadTree:
    """Split while a leaf's share of the sample stands for more than ``leaf_rows`` points."""
    codes = np.sort(morton(*unit(lat, lng)))
    most = max(1.0, min(leaf_rows / weight, len(codes) / least_leaves))
    leaves, todo = [], [(0, 0, 0, len(codes))]
    while todo:
        start, depth, a, b = todo.pop()
        if b - a <= most or depth == DEPTH - 2:
            leaves.append((start, depth, b - a))
            continue
        quarter = 1 << (2 * (DEPTH - depth - 1))
        cuts = [a, *np.searchsorted(codes[a:b], [start + q * quarter for q in (1, 2, 3)]) + a, b]
        todo += [(start + q * quarter, depth + 1, cuts[q], cuts[q + 1]) for q in range(4)]
    leaves.sort()
    starts, depths, rows = (np.array(c, np.int64) for c in zip(*leaves))
    return QuadTree(starts, depths, np.maximum(1, np.ceil(rows * weight / leaf_rows)).astype(np.int64))


def circle_boxes(lat: float, lng: float, km: float) -> list[tuple[float, float, float, float]]:
    """Boxes (min lat, max lat, min lng, max lng) that hold the circle; two across the date line."""
    angle = min(km / EARTH_KM * (1 + 1e-9) + 1e-9, math.pi)
    d = math.degrees(angle)
    low, high = lat - d, lat + d
    if low <= -90 or high >= 90:
        return [(max(low, -90.0), min(high, 90.0), -180.0, 180.0)]
    w = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-7
    if lng - w < -180:
        return [(low, high, -180.0, lng + w), (low, high, lng - w + 360, 180.0)]
    if lng + w > 180:
        return [(low, high, lng - w, 180.0), (low, high, -180.0, lng + w - 360)]
    return [(low, high, lng - w, lng + w)]


class RTree:
    """Boxes packed by sort-tile-recursive, level upon level of ``FANOUT`` children."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        strips = max(1, math.ceil(math.sqrt(n / FANOUT)))
        by_lng = np.argsort(boxes[:, 2] + boxes[:, 3], kind="stable")
        order = np.concatenate([s[np.argsort(boxes[s, 0] + boxes[s, 1], kind="stable")] for s in np.array_split(by_lng, strips)])
        self.order, level = order, boxes[order]
        self.levels = [level]
        while len(level) > 1:
            parts = range(0, len(level), FANOUT)
            level = np.array([[level[p : p + FANOUT, 0].min(), level[p : p + FANOUT, 1].max(), level[p : p + FANOUT, 2].min(), level[p : p + FANOUT, 3].max()] for p in parts])
            self.levels.append(level)

    def probe(self, lat: np.ndarray, lng: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(box, indexes of the points inside it), for each box that holds any."""
        todo = [(len(self.levels) - 1, 0, np.arange(len(lat)))]
        while todo:
            depth, k, who = todo.pop()
            b = self.levels[depth][k]
            who = who[(lat[who] >= b[0]) & (lat[who] <= b[1]) & (lng[who] >= b[2]) & (lng[who] <= b[3])]
            if not len(who):
                continue
            if depth == 0:
                yield int(self.order[k]), who
            else:
                todo += [(depth - 1, c, who) for c in range(k * FANOUT, min((k + 1) * FANOUT, len(self.levels[depth - 1])))]


def great_circle_km(lat1, lng1, lat2, lng2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def valid_coordinates(lat: str, lng: str) -> str:
    """SQL condition: both recorded, on the globe, not NaN."""
    return f"{lat} BETWEEN -90 AND 90 AND {lng} BETWEEN -180 AND 180"


def within_circles(points: DataFrame, point_id: str, lat: str, lng: str, regions: DataFrame, region_id: str, r_lat: str, r_lng: str, radius_km: str, leaf_rows: int = 100_000, leaf_regions: int = 20_000, sample_rows: int = 20_000) -> DataFrame:
    """(point_id, region_id, km): each point with each circle that covers it, border included.

    Points and regions that lack an id or a coordinate or lie off the globe, and regions with a
    null or negative radius, match nothing. Repeated rows match each for themselves.
    Circles may cross the date line or a pole. The sample of ``sample_rows`` points only shapes the
    tree; all points are joined. The driver gets that sample and one count per leaf.
    """
    p = points.select(F.col(point_id).alias("pid"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng")).where("pid IS NOT NULL AND " + valid_coordinates("lat", "lng"))
    r = regions.select(F.col(region_id).alias("rid"), F.col(r_lat).cast("double").alias("clat"), F.col(r_lng).cast("double").alias("clng"), F.col(radius_km).cast("double").alias("radius")).where("rid IS NOT NULL AND " + valid_coordinates("clat", "clng") + " AND radius >= 0 AND NOT isnan(radius)")
    n = p.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = (p if share == 1 else p.sample(share, seed=11)).select("lat", "lng").toPandas()
    tree = build_tree(drawn.lat.to_numpy(), drawn.lng.to_numpy(), 1 / share, leaf_rows)
    leaf_boxes = tree.boxes()

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, leaves, boxes = [], [], []
            for i, (la, ln, km) in enumerate(zip(b.clat, b.clng, b.radius)):
                for x in circle_boxes(la, ln, km):
                    hit = np.flatnonzero((leaf_boxes[:, 0] <= x[1]) & (leaf_boxes[:, 1] >= x[0]) & (leaf_boxes[:, 2] <= x[3]) & (leaf_boxes[:, 3] >= x[2]))
                    rows += [i] * len(hit)
                    leaves += hit.tolist()
                    boxes += [x] * len(hit)
            out = b.iloc[rows].reset_index(drop=True)
            box = np.array(boxes, float).reshape(-1, 4)
            yield out.assign(leaf=np.array(leaves, np.int64), a=box[:, 0], b=box[:, 1], c=box[:, 2], d=box[:, 3])

    rid_type, pid_type = r.schema["rid"].dataType.simpleString(), p.schema["pid"].dataType.simpleString()
    spread = r.mapInPandas(replicate, f"rid {rid_type}, clat double, clng double, radius double, leaf long, a double, b double, c double, d double")
    chunks = np.ones(len(tree.starts), np.int64)
    for row in spread.groupBy("leaf").count().collect():  # one row per leaf
        chunks[row["leaf"]] = -(-row["count"] // leaf_regions)
    salts = tree.salts

    @F.pandas_udf("leaf long, salt array<long>")
    def leaf_of(la: pd.Series, ln: pd.Series, h: pd.Series) -> pd.DataFrame:
        k = tree.leaf_of(la.to_numpy(), ln.to_numpy())
        s = h.to_numpy() % salts[k]
        if chunks.max(initial=1) == 1:
            return pd.DataFrame({"leaf": k, "salt": s[:, None].tolist()})
        return pd.DataFrame({"leaf": k, "salt": [[si + salts[ki] * c for c in range(chunks[ki])] for si, ki in zip(s, k)]})

    @F.pandas_udf("array<long>")
    def cells(leaf: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[s + salts[k] * (x % chunks[k]) for s in range(salts[k])] for k, x in zip(leaf, h)])

    # salts spread by the position and the id, so one id repeated over all rows spreads too
    left = p.withColumn("g", leaf_of("lat", "lng", F.pmod(F.xxhash64("pid", "lat", "lng"), F.lit(1 << 30)))).select("pid", "lat", "lng", "g.leaf", F.explode("g.salt").alias("salt"))
    right = spread.withColumn("salt", F.explode(cells("leaf", F.pmod(F.xxhash64("rid", "clat", "clng"), F.lit(1 << 30)))))

    def join(pts: pd.DataFrame, regs: pd.DataFrame) -> pd.DataFrame:
        who, what, far = [], [], []
        if len(pts) and len(regs):
            la, ln = pts.lat.to_numpy(), pts.lng.to_numpy()
            cla, cln, rad = regs.clat.to_numpy(), regs.clng.to_numpy(), regs.radius.to_numpy()
            for k, idx in RTree(regs[["a", "b", "c", "d"]].to_numpy()).probe(la, ln):
                km = great_circle_km(la[idx], ln[idx], cla[k], cln[k])
                near = km <= rad[k]
                who.append(idx[near])
                what.append(np.full(int(near.sum()), k))
                far.append(km[near])
        i, k, km = (np.concatenate(x) if x else np.zeros(0) for x in (who, what, far))
        # the two boxes of a circle across the date line share no point, so no pair stands twice
        i, k = i.astype(int), k.astype(int)
        return pd.DataFrame({"pid": pts.pid.to_numpy()[i], "rid": regs.rid.to_numpy()[k], "km": km})

    return left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInPandas(join, f"pid {pid_type}, rid {rid_type}, km double").withColumnsRenamed({"pid": point_id, "rid": region_id})
