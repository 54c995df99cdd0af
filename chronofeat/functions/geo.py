"""Geometry as column expressions. A geometry is struct(gtype, parts): part, ring, points (x, y); a line's part has one ring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<gtype:string,parts:array<array<array<{POINT}>>>>"
#: Metres of a degree of longitude and latitude that the planar distances of each operator use.
METRIC = {"lines": (80_000.0, 80_000.0), "points": (50_000.0, 111_000.0), "nearest": (0.45 * 111_000.0, 111_000.0), "store": (55_000.0, 111_000.0), "equator": (111_320.0, 111_320.0)}
EARTH_KM = 6371.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The polygon of an axis-aligned box, closed."""
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.struct(F.lit("Polygon").alias("gtype"), F.array(F.array(ring)).alias("parts"))


def points(geometry: Column) -> Column:
    """All points in one array."""
    return F.flatten(F.flatten(geometry["parts"]))


def bbox(geometry: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    xs, ys = _of(geometry, "x"), _of(geometry, "y")
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _of(geometry: Column, axis: str) -> Column:
    return F.transform(points(geometry), lambda p: p[axis])


def boxes_meet(a: Column, b: Column, margin: float = 0.0) -> Column:
    """Whether two boxes touch once one is widened by the margin."""
    return (a["x0"] - margin <= b["x1"]) & (b["x0"] <= a["x1"] + margin) & (a["y0"] - margin <= b["y1"]) & (b["y0"] <= a["y1"] + margin)


def _pairs(ring: Column, f, zero: str = "double") -> Column:
    """Sum of f(p, q) over a ring's or line's segments."""
    n = F.size(ring)
    terms = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), f)
    return F.when(n > 1, F.aggregate(terms, F.lit(0).cast(zero), lambda t, x: t + x)).otherwise(F.lit(0).cast(zero))


def ring_area(ring: Column) -> Column:
    """Twice-signed shoelace area halved: positive counter-clockwise."""
    return _pairs(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def polygon_area(geometry: Column) -> Column:
    """Area in squared units of the coordinates: outer rings less their holes, over all parts."""
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))), F.lit(0.0), lambda t, x: t + x)
    return F.aggregate(F.transform(geometry["parts"], part), F.lit(0.0), lambda t, x: t + x)


def polygon_area_m2(geometry: Column, metric: str = "points") -> Column:
    mx, my = METRIC[metric]
    return polygon_area(geometry) * mx * my


def vertex_centroid(geometry: Column) -> Column:
    """The mean of the first ring's points, its closing point included."""
    ring = geometry["parts"][0][0]
    mean = lambda axis: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[axis]) / F.size(ring)
    return point(mean("x"), mean("y"))


def area_centroid(geometry: Column) -> Column:
    """The centre of gravity of a polygon's parts less their holes; of a line, a point or a polygon without area, the mean of its points."""
    flat = vertex_centroid(geometry)
    sign = lambda r, i: F.when((ring_area(r) > 0) == (i == 0), 1).otherwise(-1)
    over = lambda f: F.aggregate(F.flatten(F.transform(geometry["parts"], lambda rings: F.transform(rings, lambda r, i: sign(r, i) * f(r)))), F.lit(0.0), lambda t, x: t + x)
    area = over(ring_area)
    weigh = lambda axis: over(lambda r: _pairs(r, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"]))) / (6 * area)
    whole = geometry["gtype"].isin("Polygon", "MultiPolygon") & (area != 0)
    return F.struct(F.when(whole, weigh("x")).otherwise(flat["x"]).alias("x"), F.when(whole, weigh("y")).otherwise(flat["y"]).alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point lies inside a closed ring."""
    crosses = lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)
    return _pairs(ring, crosses, "int") % 2 == 1


def point_in_polygon(x: Column, y: Column, geometry: Column) -> Column:
    """Whether a point lies in a part's outer ring and in none of its holes."""
    part = lambda rings: in_ring(x, y, rings[0]) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(x, y, r))
    return F.exists(geometry["parts"], part)


def on_boundary(x: Column, y: Column, geometry: Column) -> Column:
    """Whether a point lies on an edge of a polygon."""

    def edge(p: Column, q: Column) -> Column:
        line = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return F.when(line & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])), 1).otherwise(0)

    return F.exists(geometry["parts"], lambda rings: F.exists(rings, lambda r: _pairs(r, edge, "int") > 0))


def strictly_inside(x: Column, y: Column, geometry: Column) -> Column:
    """Whether a point lies in the interior of a polygon: not in a hole, not on an edge."""
    return point_in_polygon(x, y, geometry) & ~on_boundary(x, y, geometry)


def distance_to(x: Column, y: Column, geometry: Column) -> Column:
    """Distance of a point to a polygon, 0 inside, or to a line or point, in the unit of the coordinates."""

    def near(p: Column, q: Column) -> Column:
        dx, dy, px, py = q["x"] - p["x"], q["y"] - p["y"], x - p["x"], y - p["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))

    ring = lambda r: F.array_min(F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, -1, 1)), near))
    least = F.array_min(F.flatten(F.transform(geometry["parts"], lambda rings: F.transform(rings, ring))))
    polygon = geometry["gtype"].isin("Polygon", "MultiPolygon")
    return F.when(polygon & point_in_polygon(x, y, geometry), 0.0).otherwise(least)


def haversine_km(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a = F.pow(F.sin(F.radians(y1 - y0) / 2), 2) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(F.sin(F.radians(x1 - x0) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def planar_m(x0: Column, y0: Column, x1: Column, y1: Column, metric: str = "points") -> Column:
    """Distance with the constants of one metric."""
    mx, my = METRIC[metric]
    return F.sqrt(F.pow((x1 - x0) * mx, 2) + F.pow((y1 - y0) * my, 2))


def segment_m(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, metric: str = "points") -> Column:
    """Distance of a point to a segment."""
    mx, my = METRIC[metric]
    dx, dy, px, py = (x1 - x0) * mx, (y1 - y0) * my, (x - x0) * mx, (y - y0) * my
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))


def line_length_m(geometry: Column) -> Column:
    """Metres along all parts of a line."""
    line = lambda rings: _pairs(rings[0], lambda p, q: haversine_km(p["x"], p["y"], q["x"], q["y"]) * 1000)
    return F.aggregate(F.transform(geometry["parts"], line), F.lit(0.0), lambda t, x: t + x)


# ---------------------------------------------------------------- match scores


def match_confidence(overlap: Column, distance: Column, area_ratio: Column, shape: Column) -> Column:
    """0.4 overlap, 0.3 nearness (0 from 20 m on), 0.2 area ratio, 0.1 shape."""
    near = F.greatest(F.lit(0.0), 1 - distance / 20)
    return 0.4 * overlap + 0.3 * near + 0.2 * area_ratio + 0.1 * shape


def match_quality(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "excellent").when(confidence >= 0.6, "good").when(confidence >= 0.4, "fair").otherwise("poor")


# ---------------------------------------------------------------- other notations


def from_wkt(text: Column) -> Column:
    """POINT, LINESTRING or MULTILINESTRING, with or without heights, to a geometry; null for others."""
    text = F.trim(F.regexp_replace(text, r"(?i)^SRID=\d+;", ""))
    kind = F.upper(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    number = lambda p, k: F.element_at(F.split(F.trim(p), r"\s+"), k).cast("double")
    inner = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z\s]*\(\(?", ""), r"\)\)?\s*$", "")
    line = lambda s: F.array(F.transform(F.split(s, ","), lambda p: point(number(p, 1), number(p, 2))))
    name = F.when(kind == "POINT", "Point").when(kind == "LINESTRING", "LineString").when(kind == "MULTILINESTRING", "MultiLineString")
    return F.when(name.isNotNull(), F.struct(name.alias("gtype"), F.transform(F.split(inner, r"\)\s*,\s*\("), line).alias("parts")))


def from_esri(paths: Column, x: Column, y: Column) -> Column:
    """`paths` (array of arrays of [x, y]) to a line, else x and y to a point; null for neither."""
    line = F.transform(paths, lambda p: F.array(F.transform(p, lambda c: point(c[0], c[1]))))
    name = F.when(F.size(paths) == 1, "LineString").otherwise("MultiLineString")
    dot = F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("Point").alias("gtype"), F.array(F.array(F.array(point(x, y)))).alias("parts")))
    return F.when(F.size(paths) > 0, F.struct(name.alias("gtype"), line.alias("parts"))).otherwise(dot)


#: The reference ellipsoid, the projection's scale and false easting, the zone's central meridian.
SEMI_MAJOR, FLATTENING, SCALE, EASTING, MERIDIAN = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 9.0


def utm32_to_lonlat(easting: Column, northing: Column) -> Column:
    """Zone 32 north to degrees, by the Krüger series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = northing / (SCALE * radius), (easting - EASTING) / (SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return point(MERIDIAN + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi))


def pixel_to_geo(px: Column, py: Column, width: Column, height: Column, bounds: Column) -> Column:
    """A pixel's place by the image's bounds, rows counted from the north."""
    return point(bounds["x0"] + px / width * (bounds["x1"] - bounds["x0"]), bounds["y1"] - py / height * (bounds["y1"] - bounds["y0"]))


def affine(px: Column, py: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """World-file transform: x = a px + b py + c, y = d px + e py + f."""
    return point(a * px + b * py + c, d * px + e * py + f)


def bounds_to_affine(bounds: Column, width: Column, height: Column) -> Column:
    """The affine coefficients of an image with these bounds."""
    zero = F.lit(0.0)
    return F.struct(((bounds["x1"] - bounds["x0"]) / width).alias("a"), zero.alias("b"), bounds["x0"].alias("c"), zero.alias("d"), ((bounds["y0"] - bounds["y1"]) / height).alias("e"), bounds["y1"].alias("f"))


def metres_to_degrees(metres: float, latitude: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that span the metres at a latitude."""
    return metres / (111_320.0 * math.cos(math.radians(latitude))), metres / 111_320.0
