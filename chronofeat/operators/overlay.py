"""Polygons over polygons: the area that candidate pairs share, as Arrow kernels over whole batches.

A polygon is the signed sum of what lies below its edges, holes and clockwise rings turned to fit.
Two polygons so share the signed sum, over pairs of their edges, of what lies below both: an
integral of the lower of two straight lines, in closed form. Coordinates and offsets are read from
the Arrow buffers; no Python runs for a single point, ring or pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from . import spatial

#: Pairs of edges that are looked at together.
ROOM = 1 << 20


def spans(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of an Arrow list column, from 0 on, and its values; null counts as empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0)) if len(column) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


class Rings:
    """The rings of a batch of geometries: points x and y, first point of each ring, whether it is a hole, first ring of each row."""

    def __init__(self, geometry: pa.Array):
        parts_at, parts = spans(geometry.field("parts") if not geometry.null_count else pa.compute.struct_field(geometry, "parts"))
        rings_at, rings = spans(parts)
        points_at, points = spans(rings)
        self.x, self.y = (np.asarray(points.field(c).fill_null(np.nan), float) for c in ("x", "y"))
        self.points_at = points_at
        self.hole = np.ones(len(points_at) - 1, bool)
        self.hole[rings_at[:-1][np.diff(rings_at) > 0]] = False
        self.rings_at = rings_at[parts_at]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, x0, y0, x1, y1, sign) of edges that aren't upright, x0 < x1, and the area of each row as the last."""
        n = len(self.x)
        after = np.arange(1, n + 1)
        sizes = np.diff(self.points_at)
        full = sizes > 0
        after[self.points_at[1:][full] - 1] = self.points_at[:-1][full]  # rings close themselves
        ring = np.repeat(np.arange(len(sizes)), sizes)
        row_of_ring = np.repeat(np.arange(len(self.rings_at) - 1), np.diff(self.rings_at))
        first = self.points_at[:-1][ring]
        # about a ring's first point, so that far places cost no digits
        px, py, qx, qy = self.x - self.x[first], self.y - self.y[first], self.x[after] - self.x[first], self.y[after] - self.y[first]
        area = np.bincount(ring, px * qy - qx * py, len(sizes)) / 2
        turn = np.where((area > 0) != self.hole, 1.0, -1.0)
        areas = np.bincount(row_of_ring, turn * area, len(self.rings_at) - 1)
        upright = self.x[after] == self.x
        keep = np.flatnonzero(~upright)
        x0, y0, x1, y1 = self.x[keep], self.y[keep], self.x[after[keep]], self.y[after[keep]]
        sign = turn[ring[keep]] * np.where(x0 > x1, 1.0, -1.0)
        left = x0 > x1
        x0, x1, y0, y1 = np.where(left, x1, x0), np.where(left, x0, x1), np.where(left, y1, y0), np.where(left, y0, y1)
        return row_of_ring[ring[keep]], x0, y0, x1, y1, sign, areas


#: Edges of the larger polygon for each slab that a pair is cut into, and slabs at most.
PER_SLAB, SLABS = 8, 4096


def pieces(row: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, sign: np.ndarray, left: np.ndarray, right: np.ndarray, slabs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges cut at the slabs of their row between left and right, and at these: (slab, x0, y0, x1, y1, sign) in the order of slabs. first: number of each row's first slab."""
    wide = np.where(right > left, (right - left) / slabs, 1)[row]
    low, high = np.maximum(x0, left[row]), np.minimum(x1, right[row])
    some = low < high
    row, x0, y0, x1, y1, sign, wide, low, high = (v[some] for v in (row, x0, y0, x1, y1, sign, wide, low, high))
    begin = np.clip(((low - left[row]) / wide).astype(np.int64), 0, slabs[row] - 1)
    end = np.clip(np.ceil((high - left[row]) / wide).astype(np.int64) - 1, begin, slabs[row] - 1)
    many = end - begin + 1
    i = np.repeat(np.arange(len(row)), many)
    k = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + begin[i]
    # the first and the last piece end where the edge does, so that rounding loses nothing
    u = np.where(k == begin[i], low[i], left[row[i]] + k * wide[i])
    v = np.where(k == end[i], high[i], left[row[i]] + (k + 1) * wide[i])
    at = lambda x: y0[i] + (y1[i] - y0[i]) * ((x - x0[i]) / (x1[i] - x0[i]))
    slab = first[row[i]] + k
    order = np.argsort(slab, kind="stable")
    return tuple(x[order] for x in (slab, u, at(u), v, at(v), sign[i]))


def shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared area, area of a, area of b) of the rows of two geometry columns.

    A pair is cut into upright slabs, more of them the more edges there are, so that the pairs of
    edges that meet grow with the edges and not with their product.
    """
    ra, *ea, area_a = Rings(a).edges()
    rb, *eb, area_b = Rings(b).edges()
    n = len(a)
    bounds = {}
    for name, row, (x0, y0, x1, y1, _) in (("a", ra, ea), ("b", rb, eb)):
        left, right, low = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, np.inf)
        np.minimum.at(left, row, x0)
        np.maximum.at(right, row, x1)
        np.minimum.at(low, row, np.minimum(y0, y1))
        bounds[name] = left, right, low
    left, right = np.maximum(bounds["a"][0], bounds["b"][0]), np.minimum(bounds["a"][1], bounds["b"][1])
    apart = ~(left < right)
    left[apart] = right[apart] = 0
    low = np.minimum(bounds["a"][2], bounds["b"][2])  # heights count from the lowest point of a row, so that they stay small
    slabs = np.clip(np.maximum(np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)) // PER_SLAB, 1, SLABS)
    first = np.cumsum(slabs) - slabs
    row_of = np.repeat(np.arange(n), slabs)
    cut = lambda row, x0, y0, x1, y1, sign: pieces(row, x0, y0 - low[row], x1, y1 - low[row], sign, left, right, slabs, first)
    ka, ax0, ay0, ax1, ay1, sa = cut(ra, *ea)
    kb, bx0, by0, bx1, by1, sb = cut(rb, *eb)
    cb = np.bincount(kb, minlength=len(row_of))
    first_b = np.cumsum(cb) - cb
    out = np.zeros(n)
    per_edge = cb[ka]  # each piece of a meets all of b's in its slab
    for s, e in blocks(per_edge):
        i = np.repeat(np.arange(s, e), per_edge[s:e])
        ends = np.cumsum(per_edge[s:e])
        j = np.arange(len(i)) - np.repeat(ends - per_edge[s:e], per_edge[s:e]) + first_b[ka[i]]
        x0, x1 = np.maximum(ax0[i], bx0[j]), np.minimum(ax1[i], bx1[j])
        over = x1 > x0
        i, j, x0, x1 = i[over], j[over], x0[over], x1[over]
        at = lambda x, k, x0_, y0_, x1_, y1_: y0_[k] + (y1_[k] - y0_[k]) * ((x - x0_[k]) / (x1_[k] - x0_[k]))
        al, ar = (at(x, i, ax0, ay0, ax1, ay1) for x in (x0, x1))
        bl, br = (at(x, j, bx0, by0, bx1, by1) for x in (x0, x1))
        dl, dr = al - bl, ar - br
        spread = np.abs(dl) + np.abs(dr)
        gap = np.where(dl * dr >= 0, spread / 2, (dl * dl + dr * dr) / (2 * np.where(spread > 0, spread, 1)))
        lower = ((al + bl + ar + br) / 2 - gap) / 2 * (x1 - x0)
        out += np.bincount(row_of[ka[i]], sa[i] * sb[j] * lower, n)
    return np.clip(out, 0, np.minimum(area_a, area_b)), area_a, area_b


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges with sums of about ROOM at most; a larger one stands alone."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROOM, side="right")))
        yield a, b
        a = b


def column(values: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    """Null where a side is null."""
    return pa.array(values, pa.float64(), mask=np.asarray(a.is_null()) | np.asarray(b.is_null()))


@F.arrow_udf(T.DoubleType())
def shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two polygons, holes and all, share."""
    return column(shared(a, b)[0], a, b)


@F.arrow_udf(T.DoubleType())
def overlap_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shared area over the smaller polygon's; 0 for one without area."""
    area, x, y = shared(a, b)
    least = np.minimum(x, y)
    return column(np.where(least > 0, area / np.where(least > 0, least, 1), 0), a, b)


@F.arrow_udf(T.DoubleType())
def iou(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shared area over the union's; 0 for polygons without area."""
    area, x, y = shared(a, b)
    union = x + y - area
    return column(np.where(union > 0, area / np.where(union > 0, union, 1), 0), a, b)


def far_from(a: Rings, b: Rings, n: int) -> np.ndarray:
    """Per row the farthest that a vertex of a lies from the nearest edge of b."""
    row_of = lambda g: np.repeat(np.repeat(np.arange(n), np.diff(g.rings_at)), np.diff(g.points_at))
    ra, rb = row_of(a), row_of(b)
    last = b.points_at[1:][np.diff(b.points_at) > 0] - 1
    after = np.arange(1, len(b.x) + 1)
    after[last] = last  # an edge without length: lines end, closed rings lose nothing
    count = np.bincount(rb, minlength=n)
    first, per_vertex, out = np.cumsum(count) - count, count[ra], np.zeros(n)
    for s, e in blocks(per_vertex):
        sizes = per_vertex[s:e]
        if not sizes.sum():
            continue
        ends = np.cumsum(sizes)
        i = np.repeat(np.arange(s, e), sizes)
        j = np.arange(len(i)) - np.repeat(ends - sizes, sizes) + first[ra[i]]
        k = after[j]
        dx, dy, px, py = b.x[k] - b.x[j], b.y[k] - b.y[j], a.x[i] - b.x[j], a.y[i] - b.y[j]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / np.where(length > 0, length, 1), 0, 1)
        full = sizes > 0
        near = np.minimum.reduceat(np.hypot(px - t * dx, py - t * dy), (ends - sizes)[full])
        np.maximum.at(out, ra[np.arange(s, e)[full]], near)
    return out


@F.arrow_udf(T.DoubleType())
def hausdorff(a: pa.Array, b: pa.Array) -> pa.Array:
    """The farthest that a vertex of one outline or line lies from the other, both ways. Rings are closed ones."""
    left, right = Rings(a), Rings(b)
    return column(np.maximum(far_from(left, right, len(a)), far_from(right, left, len(a))), a, b)


# ---------------------------------------------------------------- filter and refine


def shaped(*tables: DataFrame) -> bool:
    """Whether one of the tables has polygons beside its boxes."""
    return any("geometry" in t.columns for t in tables)


#: What pairs of shapes may be judged by, each computed once a row.
MEASURES = {"_area": geo.polygon_area, "_centre": geo.area_centroid, "_mean": geo.vertex_centroid}


def with_shape(df: DataFrame, *measures: str) -> DataFrame:
    """df with its polygon `geometry` (that of the box where it has none) and measures of it; those that it has stay."""
    own = geo.box(*(F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = df.withColumn("geometry", F.coalesce("geometry", own) if "geometry" in df.columns else own)
    return rows.withColumns({m: MEASURES[m](F.col("geometry")) for m in measures if m not in df.columns})


def pairs(a: DataFrame, b: DataFrame, cell: float, *measures: str, margin: float = 0.0) -> DataFrame:
    """Pairs (a, b, most): rows with shapes whose boxes, b's widened by the margin, touch; no more than `most` of area is shared."""
    left, right = with_shape(a, *measures), with_shape(b, *measures).withColumn("_own", F.col("box"))
    right = right.withColumn("box", spatial.widened(F.col("box"), margin)) if margin else right
    found = spatial.box_join(left, right, cell)
    return found.withColumn("most", spatial.shared_area(F.col("a.box"), F.col("b._own")))


def smaller() -> Column:
    """The smaller of a pair's areas."""
    return F.least("a._area", "b._area")


def plain(found: DataFrame, *more: str) -> DataFrame:
    """Pairs with their rows as they came in, box and all."""
    fields = lambda c: [x for x in found.schema[c].dataType.names if x not in MEASURES and x != "_own"]
    row = lambda c: F.struct(*[F.col("b._own" if (c, x) == ("b", "box") else f"{c}.`{x}`").alias(x) for x in fields(c)]).alias(c)
    return found.select(row("a"), row("b"), *more)


def holds_centre(a: Column, b: Column) -> Column:
    """Whether polygon a has the centre of gravity of b in its interior."""
    return geo.strictly_inside(b["_centre"]["x"], b["_centre"]["y"], a["geometry"])
