"""Line kernels over batches against plain loops, surroundings against analytic areas, noding and pixel runs against plain fills."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofeat.functions import geo
from chronofeat.operators import kernels, lines, rasters, roads

SHAPE = pa.struct([("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])


def line_points(geometry: dict, scale: tuple[float, float]) -> np.ndarray:
    """All points of a line's parts in metres."""
    return np.array([(q["x"] * scale[0], q["y"] * scale[1]) for part in geometry["parts"] for q in part[0]], float).reshape(-1, 2)


def hausdorff_m(a: np.ndarray, b: np.ndarray) -> float:
    """The farthest that a vertex of one lies from the other, both ways."""
    return float(max(kernels.to_segments(a, b).max(), kernels.to_segments(b, a).max()))


def resample(p: np.ndarray, step: float) -> np.ndarray:
    """Points every `step` along a line, its end included."""
    lengths = np.hypot(*np.diff(p, axis=0).T)
    at = np.concatenate(([0], np.cumsum(lengths)))
    wanted = np.append(np.arange(0, at[-1], step), at[-1])
    return np.stack([np.interp(wanted, at, p[:, k]) for k in (0, 1)], axis=1)


def longest_run(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """The longest run of consecutive points of both lines that lie within the tolerance of each other, in one direction."""
    near = np.hypot(*np.moveaxis(a[:, None] - b, 2, 0)) <= tolerance
    best, run = 0, np.zeros(len(b) + 1, int)
    for row in near:
        run[1:] = np.where(row, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def run_share(a: np.ndarray, b: np.ndarray, step: float = 5.0, tolerance: float = 10.0) -> float:
    """longest_run of lines resampled every `step`, over the shorter one's points."""
    a, b = resample(a, step), resample(b, step)
    return longest_run(a, b, tolerance) / min(len(a), len(b))


def width_changed(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether ten samples of the shorter line lie 2 to 10 metres from the other on the mean."""
    length = lambda p: np.hypot(*np.diff(p, axis=0).T).sum() if len(p) > 1 else 0.0
    a, b = (a, b) if length(a) <= length(b) else (b, a)
    at = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(a, axis=0).T)))) if len(a) > 1 else np.zeros(1)
    wanted = np.linspace(0, at[-1], 10)
    samples = np.stack([np.interp(wanted, at, a[:, k]) for k in (0, 1)], axis=1)
    return bool(2 <= kernels.to_segments(samples, b).mean() <= 10)


def same_ends(a: np.ndarray, b: np.ndarray, radius: float = 50.0) -> bool:
    """Whether both ends lie near the other's, in either direction."""
    near = lambda p, q: np.hypot(*(p - q)) <= radius
    return bool(near(a[0], b[0]) and near(a[-1], b[-1]) or near(a[0], b[-1]) and near(a[-1], b[0]))


def line(points):
    return {"gtype": "LineString", "parts": [[[{"x": float(x), "y": float(y)} for x, y in points]]]}


def walks(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.random() * 60, rng.random() * 60
        points = []
        for _ in range(rng.randrange(1, 6)):
            points.append((x, y))
            x, y = x + rng.uniform(-10, 40), y + rng.uniform(-20, 20)
        out.append(line(points))
    return out


def read(rows):
    return lines.Lines.read(pa.array(rows, SHAPE), (1.0, 1.0))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    a, b = walks(rng, 150), walks(rng, 150)
    b[:20] = a[:20]
    return a, b


def test_runs_distances_and_ends(pairs, monkeypatch):
    points = [[line_points(g, (1.0, 1.0)) for g in side] for side in pairs]
    a, b = map(read, pairs)
    each = lambda f: [f(p, q) for p, q in zip(*points, strict=True)]
    for _ in range(2):
        assert lines.run_shares(a, b, 5.0, 10.0).tolist() == each(run_share)
        assert lines.hausdorff(a, b) == pytest.approx(each(hausdorff_m))
        assert lines.same_ends(a, b, 50.0).tolist() == each(same_ends)
        assert lines.width_changed(a, b, 2.0, 10.0).tolist() == each(width_changed)
        monkeypatch.setattr("chronofeat.operators.overlay.ROOM", 50)  # the same in small blocks


def test_surroundings_of_known_areas():
    capsule, lens = 2000 + math.pi * 100, lambda d: 2 * 100 * math.acos(d / 20) - d / 2 * math.sqrt(400 - d * d)
    cases = [
        (line([(0, 0), (100, 0)]), line([(0, 0), (100, 0)]), capsule),
        (line([(0, 0), (100, 0)]), line([(0, 5), (100, 5)]), 1500 + lens(5)),
        (line([(0, 0)]), line([(10, 0)]), lens(10)),
        (line([(0, 0), (50, 0), (100, 0)]), line([(100, 0), (0, 0)]), capsule),
        (line([(0, 0), (100, 0)]), line([(50, -50), (50, 50)]), 400),
        (line([(0, 0), (100, 0), (0, 0)]), line([(0, 0), (100, 0)]), capsule),
        (line([(0, 0), (100, 0)]), line([(0, 500), (100, 500)]), 0),
        (line([(1e6, 1e6), (1e6 + 100, 1e6)]), line([(1e6, 1e6), (1e6 + 100, 1e6)]), capsule),
    ]
    a, b = read([c[0] for c in cases]), read([c[1] for c in cases])
    shared, left, right = lines.surroundings(a, b, 10.0)
    assert shared == pytest.approx([c[2] for c in cases], rel=1e-9, abs=1e-9)
    assert left[0] == pytest.approx(capsule) and right[2] == pytest.approx(math.pi * 100)
    assert lines.buffer_shares(a, b, 10.0)[[0, 3, 5, 6]].tolist() == pytest.approx([1, 1, 1, 0])


def test_surroundings_against_samples(pairs):
    a, b = ([x for x in side[:40]] for side in pairs)
    shared, left, right = lines.surroundings(read(a), read(b), 10.0)
    rng = np.random.default_rng(1)
    for k in range(0, 40, 3):
        p, q = line_points(a[k], (1.0, 1.0)), line_points(b[k], (1.0, 1.0))
        low, high = np.minimum(p.min(axis=0), q.min(axis=0)) - 10, np.maximum(p.max(axis=0), q.max(axis=0)) + 10
        at = rng.uniform(low, high, (60_000, 2))
        inside = [kernels.to_segments(at, g) <= 10 for g in (p, q)]
        whole = (high - low).prod()
        for area, hit in ((shared[k], inside[0] & inside[1]), (left[k], inside[0]), (right[k], inside[1])):
            assert area == pytest.approx(hit.mean() * whole, abs=5 * whole * math.sqrt(max(hit.mean() * (1 - hit.mean()), 1e-5) / len(at)))


def test_columns(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(*pairs, strict=True))] + [(900, None, pairs[0][0])], f"id long, a {geo.GEOMETRY}, b {geo.GEOMETRY}")
    found = df.select("id", lines.run_share()("a", "b").alias("run"), lines.buffer_share(10.0)("a", "b").alias("share"), lines.line_closeness((1.0, 1.0), 10.0, 20.0)("a", "b").alias("c")).collect()
    share, far = lines.buffer_shares(*map(read, pairs), 10.0), lines.hausdorff(*map(read, pairs))
    for r in found[:-1]:
        assert r.share == pytest.approx(share[r.id]) and r.c.share == pytest.approx(share[r.id] if far[r.id] <= 20 else 0)
    assert found[-1].run is None and found[-1].share is None


# ---------------------------------------------------------------- noding


def pieces(rows):
    """Each line cut at every place where another segment meets it; exact for the small whole numbers of the test."""
    from fractions import Fraction

    segments = [(i, k, *map(Fraction, (*p, *q))) for i, points in rows for k, (p, q) in enumerate(zip(points, points[1:], strict=False)) if p != q]
    out = {}
    for i, points in rows:
        cuts = set()
        for j, k, x0, y0, x1, y1 in segments:
            if j != i:
                continue
            dx, dy = x1 - x0, y1 - y0
            for o, n, u0, v0, u1, v1 in segments:
                if o == i and abs(n - k) <= 1:
                    continue
                ex, ey = u1 - u0, v1 - v0
                cross = dx * ey - dy * ex
                if cross:
                    t, u = ((u0 - x0) * ey - (v0 - y0) * ex) / cross, ((u0 - x0) * dy - (v0 - y0) * dx) / cross
                    found = [t] if 0 <= u <= 1 else []
                elif (u0 - x0) * dy == (v0 - y0) * dx:
                    found = [((u - x0) * dx + (v - y0) * dy) / (dx * dx + dy * dy) for u, v in ((u0, v0), (u1, v1))]
                else:
                    found = []
                cuts |= {k + t for t in found if 0 <= t <= 1}
        last = len(points) - 1
        at = sorted({0, last, *(c for c in cuts if 0 < c < last)}) if last > 0 else []

        def place(c, points=points, last=last):
            k = min(int(c), last - 1)
            (x0, y0), (x1, y1) = points[k], points[k + 1]
            return float(x0 + (x1 - x0) * (c - k)), float(y0 + (y1 - y0) * (c - k))

        for part, (s, e) in enumerate(zip(at, at[1:], strict=False)):
            out[i, part] = [place(s), *(tuple(map(float, points[k])) for k in range(last + 1) if s < k < e), place(e)]
        if last <= 0:
            out[i, 0] = [tuple(map(float, p)) for p in points]
    return out


def test_split_lines(spark):
    rng = random.Random(6)
    rows = [(i, [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(2, 6))]) for i in range(40)]
    rows += [(100, [(20, 0), (30, 0)]), (101, [(25, 0), (25, 5)]), (102, [(22, 0), (28, 0)]), (103, [(30, 0), (40, 0)]), (104, [(50, 50)]), (105, [])]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in rows], "id long, points array<struct<x:double,y:double>>")
    found = {(r.id, r.part): [tuple(p) for p in r.points] for r in roads.split_lines(df, 4.0).collect()}
    expected = pieces(rows)
    assert set(found) == set(expected)
    for k, points in expected.items():
        assert np.array(found[k]).ravel() == pytest.approx(np.array(points).ravel(), abs=1e-6), k
    assert [found[100, k][0] for k in range(4)] == [(20.0, 0.0), (22.0, 0.0), (25.0, 0.0), (28.0, 0.0)]
    assert roads.split_lines(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pixels


def test_pixels_of_footprints(spark):
    """Concave and holed shapes, some partly outside a tile, against a fill pixel by pixel."""
    rng = random.Random(11)
    shapes = []
    for i in range(40):
        x, y, n = rng.uniform(-30, 130), rng.uniform(-30, 130), rng.randrange(3, 9)
        ring = [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((2 * math.pi * k / n, rng.uniform(4, 40)) for k in range(n))]
        hole = [(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1)]
        shapes.append((i, [[ring, hole] if i % 3 == 0 else [ring]]))
    shapes.append((50, [[[(10, 10), (30, 10), (30, 30), (20, 30), (20, 20), (10, 20)]]]))
    struct = lambda parts: ("Polygon", [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts])
    df = spark.createDataFrame([(i, struct(p)) for i, p in shapes] + [(60, None)], f"id long, geometry {geo.GEOMETRY}").withColumn("box", F.coalesce(geo.bbox(F.col("geometry")), F.struct(*[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])))
    tiles = spark.createDataFrame([("t", (0.0, 0.0, 100.0, 100.0), 25, 20), ("u", (100.0, 0.0, 200.0, 100.0), 10, 10)], "tile string, box struct<x0:double,y0:double,x1:double,y1:double>, width int, height int")

    def inside(parts, x, y):
        odd = False
        for part in parts:
            for ring in part:
                for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
                    if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                        odd = not odd
        return odd

    expected = {(i, t, r, c) for t, x0, w, h in (("t", 0, 25, 20), ("u", 100, 10, 10)) for i, p in shapes for r in range(h) for c in range(w) if inside(p, x0 + (c + 0.5) * 100 / w, 100 - (r + 0.5) * 100 / h)}
    runs = rasters.footprint_runs(df, tiles)
    rows = runs.collect()
    found = [(r.id, r.tile, r["row"], c) for r in rows for c in range(r.first, r.last + 1)]
    assert len(found) == len(set(found)) and set(found) == expected

    lit = {(t, r, c) for i, t, r, c in expected if i % 2}
    masks = rasters.merged_runs(runs.where("id % 2 = 1"))
    once = [(m.tile, m["row"], c) for m in masks.collect() for c in range(m.first, m.last + 1)]
    assert len(once) == len(lit) and set(once) == lit
    again = rasters.runs_from_pixels(spark.createDataFrame([*once, once[0]], "tile string, row long, col long"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, masks.collect()))
    shares = {}
    for i, t, r, c in expected:
        shares.setdefault(i, {}).setdefault(t, []).append((t, r, c) in lit)
    best = {i: min(((-sum(x) / len(x), -len(x), t) for t, x in of.items())) for i, of in shares.items()}
    seen = {r.id: (-r.share, -r.pixels, r.tile) for r in rasters.presence(runs, masks).collect()}
    near = lambda of: {i: (round(x[0], 9), *x[1:]) for i, x in of.items()}
    assert near(seen) == near(best)


def test_a_match_computes_what_is_asked_alone(monkeypatch):
    called = []
    for name in ("run_shares", "hausdorff", "width_changed", "same_ends"):
        monkeypatch.setattr(lines, name, lambda p, q, *more, name=name, plain=getattr(lines, name): (called.append(name), plain(p, q, *more))[1])
    shape = lambda y: pa.array([{"parts": [[[{"x": 0.0, "y": y}, {"x": 90.0, "y": y}]]]}])
    got = lines.line_match((1.0, 1.0), only=("width_change",)).func(shape(0.0), shape(3.0)).to_pylist()
    assert got == [{"width_change": True}] and called == ["width_changed"]
    whole = lines.line_match((1.0, 1.0)).func(shape(0.0), shape(3.0)).to_pylist()
    assert whole == [{"lss": 1.0, "hausdorff": 3.0, "width_change": True, "same_ends": True}]
