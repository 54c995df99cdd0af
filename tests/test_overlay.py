"""Polygon overlay, outlines and the box join against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofeat.functions import geo
from chronofeat.operators import link, overlay, spatial

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPE = pa.struct([("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(POINT))))])


def rings_of(geometry: dict) -> list[np.ndarray]:
    """Closed rings as point arrays, outer ones counter-clockwise and holes clockwise."""
    out = []
    for part in geometry["parts"]:
        for k, ring in enumerate(part):
            p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
            if len(p) > 1 and (p[0] == p[-1]).all():
                p = p[:-1]
            if len(p) > 2:
                out.append(p if (signed_area(p) > 0) == (k == 0) else p[::-1])
    return out


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another one, both counter-clockwise."""
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(subject):
            break
        side = (b[0] - a[0]) * (subject[:, 1] - a[1]) - (b[1] - a[1]) * (subject[:, 0] - a[0])
        after, next_side = np.roll(subject, -1, axis=0), np.roll(side, -1)
        out = []
        for p, q, s, t in zip(subject, after, side, next_side, strict=True):
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                out.append(p + (q - p) * (s / (s - t)))
        subject = np.array(out).reshape(-1, 2)
    return subject


def intersection_area(a: dict, b: dict) -> float:
    """Exact: both polygons are fans of signed triangles from a common origin, clipped pair by pair."""
    left, right = rings_of(a), rings_of(b)
    if not left or not right:
        return 0.0
    origin = left[0][0]
    fan = lambda rings: [(np.stack((np.zeros(2), p, q)), np.sign(s)) for r in rings for p, q in zip(r - origin, np.roll(r - origin, -1, axis=0), strict=True) if (s := p[0] * q[1] - q[0] * p[1])]
    total = 0.0
    second = fan(right)
    for t, s in fan(left):
        t = t if s > 0 else t[::-1]
        for u, v in second:
            shared = clip(t, u if v > 0 else u[::-1])
            if len(shared) > 2:
                total += s * v * abs(signed_area(shared))
    return total


def star(rng, x, y, radius, n):
    ring = [{"x": x + r * math.cos(t), "y": y + r * math.sin(t)} for t, r in ((2 * math.pi * k / n, radius * (0.4 + 0.6 * rng.random())) for k in range(n))]
    return ring if rng.random() < 0.5 else ring[::-1]


def polygon(rng, far=1e5):
    x, y = far + rng.random() * 20, 2 * far + rng.random() * 20
    ring = star(rng, x, y, 20, rng.randrange(5, 14))
    hole = [{"x": x + i, "y": y + j} for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    parts = [[ring + [ring[0]], hole] if rng.random() < 0.4 else [ring]]
    if rng.random() < 0.3:
        parts.append([star(rng, x + 60, y, 20, 6)])
    return {"gtype": "MultiPolygon", "parts": parts}


def test_shared_area_against_clipped_fans():
    rng = random.Random(4)
    a, b = ([polygon(rng) for _ in range(60)] for _ in range(2))
    found, left, right = overlay.shared(pa.array(a, SHAPE), pa.array(b, SHAPE))
    assert found == pytest.approx([intersection_area(x, y) for x, y in zip(a, b, strict=True)], abs=1e-8)
    assert left == pytest.approx([sum(signed_area(r) for r in rings_of(x)) for x in a])
    same = overlay.shared(pa.array(a, SHAPE), pa.array(a, SHAPE))[0]
    assert same == pytest.approx(left)


def test_odd_shapes():
    rng = random.Random(1)
    one, two = polygon(rng), polygon(rng)
    none = {"gtype": "Polygon", "parts": []}
    flat = {"gtype": "Polygon", "parts": [[[{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 5.0}]]]}
    a, b = pa.array([None, one, none, flat, two], SHAPE), pa.array([one, None, one, one, two], SHAPE)
    found = overlay.column(overlay.shared(a, b)[0], a, b).to_pylist()
    assert found[:4] == [None, None, 0, 0] and found[4] > 0
    assert len(overlay.shared(a.slice(0, 0), b.slice(0, 0))[0]) == 0
    assert overlay.shared(a.slice(4), b.slice(4))[0][0] == pytest.approx(found[4])


def test_blocks_of_edges(monkeypatch):
    rng = random.Random(7)
    a, b = (pa.array([polygon(rng) for _ in range(20)], SHAPE) for _ in range(2))
    whole, far = overlay.shared(a, b)[0], overlay.far_from(overlay.Rings(a), overlay.Rings(b), 20)
    monkeypatch.setattr(overlay, "ROOM", 7)
    assert overlay.shared(a, b)[0] == pytest.approx(whole)
    assert overlay.far_from(overlay.Rings(a), overlay.Rings(b), 20) == pytest.approx(far)


@pytest.mark.parametrize("per_slab", [1, 2, 1000])
def test_slabs(monkeypatch, per_slab):
    """The same areas for any number of slabs; two fine polygons share what coarse ones do."""
    rng = random.Random(12)
    a, b = ([polygon(rng) for _ in range(30)] for _ in range(2))
    whole = [intersection_area(x, y) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(overlay, "PER_SLAB", per_slab)
    assert overlay.shared(pa.array(a, SHAPE), pa.array(b, SHAPE))[0] == pytest.approx(whole, abs=1e-8)
    disc = lambda x, n: {"gtype": "Polygon", "parts": [[[{"x": x + 10 * math.cos(2 * math.pi * k / n), "y": 10 * math.sin(2 * math.pi * k / n)} for k in range(n)]]]}
    lens = 2 * 100 * math.acos(0.35) - 7 / 2 * math.sqrt(400 - 49)
    n = 20_000 if per_slab == 2 else 600
    found = overlay.shared(pa.array([disc(0, n), disc(0, n)], SHAPE), pa.array([disc(7, n), disc(30, n)], SHAPE))[0]
    assert found == pytest.approx([lens, 0], rel=1e-4 if n == 600 else 1e-6)


def test_hausdorff_against_loops():
    rng = random.Random(3)
    line = lambda: {"gtype": "LineString", "parts": [[[{"x": rng.random() * 9, "y": rng.random() * 9} for _ in range(rng.randrange(1, 6))]]]}
    a, b = ([line() for _ in range(40)] for _ in range(2))

    def far(p, q):
        def to(x, s, t):
            dx, dy = t["x"] - s["x"], t["y"] - s["y"]
            k = max(0, min(1, ((x["x"] - s["x"]) * dx + (x["y"] - s["y"]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            return math.hypot(x["x"] - s["x"] - k * dx, x["y"] - s["y"] - k * dy)

        p, q = p["parts"][0][0], q["parts"][0][0]
        return max(min(to(x, s, t) for s, t in zip(q, q[1:] or q, strict=False)) for x in p)

    left, right = overlay.Rings(pa.array(a, SHAPE)), overlay.Rings(pa.array(b, SHAPE))
    assert overlay.far_from(left, right, 40) == pytest.approx([far(x, y) for x, y in zip(a, b, strict=True)])


def test_centres_and_distances(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    bay = {"gtype": "Polygon", "parts": [[ring((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0))]]}
    holed = {"gtype": "Polygon", "parts": [[ring((0, 0), (30, 0), (30, 30), (0, 30), (0, 0)), ring((10, 10), (10, 20), (20, 20), (20, 10), (10, 10))]]}
    df = spark.createDataFrame([(bay,), (holed,)], f"g {geo.GEOMETRY}")
    at = [(15, 20), (5, 5), (10, 15), (31, 30), (15, 15)]
    inside = df.select(*[geo.strictly_inside(F.lit(float(x)), F.lit(float(y)), F.col("g")) for x, y in at]).collect()
    assert [list(r) for r in inside] == [[False, True, False, False, False], [False, True, False, False, False]]
    apart = df.select(*[geo.distance_to(F.lit(float(x)), F.lit(float(y)), F.col("g")) for x, y in at]).collect()
    assert [list(r) for r in apart] == [[5.0, 0.0, 0.0, 1.0, 5.0], [0.0, 0.0, 0.0, 1.0, 5.0]]
    centres = df.select(geo.area_centroid(F.col("g")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in centres] == [(15.0, pytest.approx((900 * 15 - 200 * 20) / 700)), (15.0, 15.0)]


def boxes(rng, n, wide):
    out = []
    for i in range(n):
        x, y = rng.randrange(4000), rng.randrange(4000)
        out.append((i, x, y, x + rng.choice(wide), y + rng.choice(wide)))
    return out


def joined(spark, a, b, cell):
    df = lambda rows: spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    as_float = lambda rows: [(r[0], *map(float, r[1:])) for r in rows]
    return spatial.box_join(df(as_float(a)), df(as_float(b)), cell)


@pytest.mark.parametrize(("wide_a", "wide_b"), [([0], [0, 60]), ([0, 3, 70, 900], [1, 40, 4000]), ([5], [5]), ([4000], [0])])
def test_box_join(spark, wide_a, wide_b):
    rng = random.Random(9)
    a, b = boxes(rng, 150, wide_a), boxes(rng, 150, wide_b)
    found = [tuple(r) for r in joined(spark, a, b, 64.0).select("a.id", "b.id").collect()]
    expected = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(found) == sorted(expected)


def test_few_large_boxes_cost_little(spark):
    """Rows on either side of the join stay below twice as many when a box of a million units comes to 2,000 ordinary ones."""
    rng = random.Random(2)
    ordinary = boxes(rng, 2000, [40, 60])
    df = lambda rows: spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "id long, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    rows = lambda t, u: spatial._cells(t, "a", 64.0, spatial._levels(u, 64.0)).count()
    plain, odd = df(ordinary), df([*ordinary, (2000, 0, 0, 10**12, 10**12)])
    assert rows(odd, odd) < 2 * rows(plain, plain)
    # a tenth of the rows in a place no wider than a cell are spread over many small cells
    dense = df([*ordinary, *[(3000 + i, x, y, x + 1, y + 1) for i, (x, y) in enumerate((rng.random() * 60, rng.random() * 60) for _ in range(220))]])
    cells = spatial._cells(dense.where("id >= 3000"), "a", 64.0, spatial._levels(dense, 64.0)).where("meets < 0")
    assert cells.groupBy("meets", "cx", "cy").count().agg(F.max("count")).first()[0] < 10


def test_links_of_rows_without_polygon(spark):
    """A row without a polygon counts by its box; columns of rows stay."""
    ell = {"gtype": "Polygon", "parts": [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 10.0), (5.0, 5.0), (0.0, 5.0))]]]}
    schema = f"id long, _n string, box struct<x0:double,y0:double,x1:double,y1:double>, geometry {geo.GEOMETRY}"
    a = spark.createDataFrame([(1, "x", (0.0, 0.0, 10.0, 10.0), ell), (2, "y", (0.0, 5.0, 5.0, 10.0), None), (3, "z", None, None)], schema)
    found = link.link_by_overlap(a, a.drop("geometry"), 0.1)
    assert sorted((r.a.id, r.b.id, round(r.score, 6), r.a["_n"]) for r in found.collect()) == [(1, 1, 1.0, "x"), (2, 1, 1.0, "y"), (2, 2, 1.0, "y")]
    assert link.link_by_overlap(a.limit(0), a).count() == 0
    assert [tuple(r) for r in link.duplicate_pairs(a, 0.2).collect()] == []
