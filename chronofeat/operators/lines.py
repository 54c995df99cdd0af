"""Lines against lines over whole Arrow batches: runs of samples that keep together, distances, and the area that their surroundings share.

A line is the points of all its parts in order. Coordinates are read from the Arrow buffers and
scaled to metres; everything is done for all pairs of a batch at once, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .overlay import Rings, blocks

Scale = tuple[float, float]


class Lines:
    """Points x and y of a batch of lines, and where each line begins in them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, at: np.ndarray):
        self.x, self.y, self.at = x, y, at
        self.count = np.diff(at)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    @classmethod
    def read(cls, geometry: pa.Array, scale: Scale) -> Lines:
        rings = Rings(geometry)
        return cls(rings.x * scale[0], rings.y * scale[1], rings.points_at[rings.rings_at])

    def steps(self) -> np.ndarray:
        """Length from each point to the next one of its line, 0 for the last."""
        out = np.zeros(len(self.x))
        if len(self.x) > 1:
            same = self.row[1:] == self.row[:-1]
            out[:-1] = np.where(same, np.hypot(np.diff(self.x), np.diff(self.y)), 0)
        return out

    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, self.steps(), len(self.count))

    def sampled(self, step: np.ndarray) -> Lines:
        """Points every `step` (one number a line) along each line, its end included."""
        steps = self.steps()
        total = np.bincount(self.row, steps, len(self.count))
        some = self.count > 0
        return self._at(np.where(some, np.ceil(total / step).astype(np.int64) + 1, 0), step, steps, total)

    def spread(self, samples: int) -> Lines:
        """So many points along each line, ends included, at equal ways."""
        steps, total = self.steps(), self.lengths()
        return self._at(np.where(self.count > 0, samples, 0), total / (samples - 1), steps, total)

    def _at(self, many: np.ndarray, step: np.ndarray, steps: np.ndarray, total: np.ndarray) -> Lines:
        row = np.repeat(np.arange(len(many)), many)
        first = np.cumsum(many) - many
        k = np.arange(len(row)) - first[row]
        wanted = np.where(k == many[row] - 1, total[row], k * step[row])
        # length along its own line up to each point; lines stand apart so that one search serves all
        ahead = np.cumsum(steps) - steps
        along = ahead - ahead[np.minimum(self.at[:-1], max(len(self.x) - 1, 0))][self.row] if len(self.x) else ahead
        gap = 2 * (float(total.max(initial=0)) + 1)
        i = np.searchsorted(along + self.row * gap, wanted + row * gap, side="right") - 1
        i = np.clip(i, self.at[:-1][row], np.maximum(self.at[1:][row] - 2, self.at[:-1][row]))
        j = np.minimum(i + 1, self.at[1:][row] - 1)
        t = np.clip((wanted - along[i]) / np.where(steps[i] > 0, steps[i], 1), 0, 1)
        return Lines(self.x[i] + (self.x[j] - self.x[i]) * t, self.y[i] + (self.y[j] - self.y[i]) * t, np.append(first, len(row)))

    def distances(self, other: Lines) -> np.ndarray:
        """Of each point the distance to the other line of its row, by segments; infinite to an empty one."""
        out, per_point = np.full(len(self.x), np.inf), other.count[self.row]
        for s, e in blocks(per_point):
            sizes = per_point[s:e]
            if not sizes.sum():
                continue
            ends = np.cumsum(sizes)
            i = np.repeat(np.arange(s, e), sizes)
            j = np.arange(len(i)) - np.repeat(ends - sizes, sizes) + other.at[:-1][self.row[i]]
            k = np.minimum(j + 1, other.at[1:][self.row[i]] - 1)
            d = to_segment(self.x[i], self.y[i], other.x[j], other.y[j], other.x[k], other.y[k])
            full = sizes > 0
            out[s:e][full] = np.minimum.reduceat(d, (ends - sizes)[full])
        return out

    def farthest(self, other: Lines) -> np.ndarray:
        out = np.zeros(len(self.count))
        np.maximum.at(out, self.row, self.distances(other))
        return out


def to_segment(x, y, x0, y0, x1, y1) -> np.ndarray:
    """Distance of points to segments, elementwise."""
    dx, dy, px, py = x1 - x0, y1 - y0, x - x0, y - y0
    length = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / np.where(length > 0, length, 1), 0, 1)
    return np.hypot(px - t * dx, py - t * dy)


def hausdorff(a: Lines, b: Lines) -> np.ndarray:
    """Per row the farthest that a vertex of one lies from the other, both ways."""
    return np.maximum(a.farthest(b), b.farthest(a))


def run_shares(a: Lines, b: Lines, step: float, tolerance: float) -> np.ndarray:
    """Per row the longest run of consecutive samples of both lines within the tolerance of each other, in one direction, over the shorter one's samples.

    The matrix of near samples is laid out diagonal after diagonal; a run is the way since the last
    sample that was not near. Samples farther than the tolerance from the other line's box stand at
    no end of a run, and what lies before the first and after the last of the others is left out.
    """
    n, fixed = len(a.count), np.full(len(a.count), float(step))
    p, q = a.sampled(fixed), b.sampled(fixed)
    shorter = np.minimum(p.count, q.count)
    (p0, pn), (q0, qn) = (_reach(u, v, tolerance) for u, v in ((p, q), (q, p)))
    best = np.zeros(n, np.int64)
    diagonals = np.where((pn > 0) & (qn > 0), pn + qn - 1, 0)
    row = np.repeat(np.arange(n), diagonals)
    d = np.arange(len(row)) - (np.cumsum(diagonals) - diagonals)[row] - (pn[row] - 1)
    i0, size = np.maximum(-d, 0), np.minimum(pn[row], qn[row] - d) - np.maximum(-d, 0)
    for s, e in blocks(size):
        of = np.repeat(np.arange(s, e), size[s:e])
        begin = np.cumsum(size[s:e]) - size[s:e]
        k = np.arange(len(of)) - begin[of - s]
        i = p0[row[of]] + i0[of] + k
        j = q0[row[of]] + i0[of] + d[of] + k
        near = np.hypot(p.x[i] - q.x[j], p.y[i] - q.y[j]) <= tolerance
        place = np.arange(len(of))
        broken = np.maximum.accumulate(np.where(near, -1, place))
        run = np.where(near, place - np.maximum(broken, begin[of - s] - 1), 0)
        np.maximum.at(best, row[of], run)
    return best / np.maximum(shorter, 1)


def _reach(p: Lines, q: Lines, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the samples of p from the first to the last that lies within the tolerance of q's box."""
    n = len(p.count)
    low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    for k, c in enumerate((q.x, q.y)):
        np.minimum.at(low[k], q.row, c)
        np.maximum.at(high[k], q.row, c)
    inside = np.ones(len(p.x), bool)
    for k, c in enumerate((p.x, p.y)):
        inside &= (c >= low[k][p.row] - tolerance) & (c <= high[k][p.row] + tolerance)
    at = np.flatnonzero(inside)
    first, last = np.full(n, len(p.x)), np.full(n, -1)
    np.minimum.at(first, p.row[at], at)
    np.maximum.at(last, p.row[at], at)
    return np.minimum(first, np.maximum(last, 0)), np.maximum(last - first + 1, 0)


def width_changed(a: Lines, b: Lines, low: float, high: float, samples: int = 10) -> np.ndarray:
    """Per row whether samples of the shorter line lie low to high from the other on the mean."""
    mean = lambda u, v: _means(u.spread(samples), v)
    apart = np.where(a.lengths() <= b.lengths(), mean(a, b), mean(b, a))
    return (low <= apart) & (apart <= high)


def _means(samples: Lines, other: Lines) -> np.ndarray:
    return np.bincount(samples.row, samples.distances(other), len(samples.count)) / np.maximum(samples.count, 1)


def same_ends(a: Lines, b: Lines, radius: float) -> np.ndarray:
    """Per row whether both ends lie within the radius of the other's, in either direction."""
    some = (a.count > 0) & (b.count > 0)
    end = lambda g, last: np.where(g.count > 0, g.at[1:] - 1 if last else g.at[:-1], 0)

    def near(i: bool, j: bool) -> np.ndarray:
        if not len(a.x) or not len(b.x):
            return np.zeros(len(some), bool)
        p, q = end(a, i), end(b, j)
        return np.hypot(a.x[p] - b.x[q], a.y[p] - b.y[q]) <= radius

    return some & (near(False, False) & near(True, True) | near(False, True) & near(True, False))


# ---------------------------------------------------------------- surroundings


def surroundings(a: Lines, b: Lines, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row (shared area, area of a's surroundings, of b's): all that lies within the radius of a line. Exact but for rounding.

    The surroundings of a line are the union of its segments' capsules. An area is an integral
    along its boundary: sides and caps of capsules, cut wherever they meet another capsule's side or
    circle. A cut piece counts if its middle lies in no other capsule of its line, and for the
    shared area within the other line's surroundings; of pieces that coincide the first counts.
    """
    n = len(a.count)
    shared, own_a, own_b = np.zeros(n), np.zeros(n), np.zeros(n)
    many = np.maximum(a.count - 1, np.minimum(a.count, 1)), np.maximum(b.count - 1, np.minimum(b.count, 1))
    kinds = many[0] * (1 << 31) + many[1]
    for kind in np.unique(kinds[(many[0] > 0) & (many[1] > 0)]).tolist():  # rows with as many segments go together
        rows = np.flatnonzero(kinds == kind)
        ma, mb = kind >> 31, kind & ((1 << 31) - 1)
        m = ma + mb
        step = max(1, (1 << 21) // (4 * m * (12 * m + 1) * m))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            ends = np.concatenate([_segments(g, some, k) for g, k in ((a, ma), (b, mb))], axis=1)
            shared[some], own_a[some], own_b[some] = _areas(ends, ma, radius)
    return shared, own_a, own_b


def _segments(g: Lines, rows: np.ndarray, many: int) -> np.ndarray:
    """(row, segment, end, axis); a single point is a segment without length."""
    i = g.at[:-1][rows][:, None] + np.arange(many)
    j = np.minimum(i + 1, g.at[1:][rows][:, None] - 1)
    return np.stack([np.stack([g.x[k], g.y[k]], axis=-1) for k in (i, j)], axis=2)


def _areas(ends: np.ndarray, ma: int, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Areas by row of capsules (row, capsule, end, axis), the first `ma` of a."""
    n, m = ends.shape[:2]
    ends = ends - ends[:, :1, :1]  # about a point of the row, so that far places cost no digits
    d = ends[:, :, 1] - ends[:, :, 0]
    length = np.hypot(d[..., 0], d[..., 1])
    d = np.where(length[..., None] > 0, d / np.where(length > 0, length, 1)[..., None], [1.0, 0.0])
    normal = np.stack([-d[..., 1], d[..., 0]], axis=-1)
    start = np.arctan2(-normal[..., 1], -normal[..., 0])
    # boundaries, counter-clockwise: right side, cap at the end, left side, cap at the beginning
    origin = np.stack([ends[:, :, 0] - r * normal, ends[:, :, 1] + r * normal], axis=2)
    way = np.stack([d, -d], axis=2)
    centre = ends[:, :, ::-1]
    angle = np.stack([start, start + np.pi], axis=2)
    flat = lambda x: x.reshape(n, 2 * m, *x.shape[3:])
    origin, way, centre, angle = map(flat, (origin, way, centre, angle))
    span = np.repeat(length, 2, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):  # cuts too many do no harm, so what only touches is clipped to a cut
        # sides: parameter along them of other sides' lines and of circles
        to = origin[:, None, :] - origin[:, :, None]
        cross = lambda p, q: p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
        dot = lambda p, q: (p * q).sum(axis=-1)
        on_lines = cross(to, way[:, None, :]) / cross(way[:, :, None], way[:, None, :])
        back = centre[:, None, :] - origin[:, :, None]
        mid = dot(back, way[:, :, None])
        half = np.sqrt(np.maximum(r * r - cross(back, way[:, :, None]) ** 2, 0))
        sides = np.concatenate([on_lines, mid - half, mid + half], axis=2) / np.where(span > 0, span, 1)[..., None]
        # caps: angle on them of other circles and of sides' lines
        apart = centre[:, None, :] - centre[:, :, None]
        gap = np.hypot(apart[..., 0], apart[..., 1])
        toward, open_ = np.arctan2(apart[..., 1], apart[..., 0]), np.arccos(np.minimum(gap / (2 * r), 1))
        off = cross(way[:, None, :], centre[:, :, None] - origin[:, None, :])  # of the line's left
        lean, wide = np.arctan2(way[:, None, :, 0], -way[:, None, :, 1]), np.arccos(np.clip(-off / r, -1, 1))
        lean = np.broadcast_to(lean, wide.shape)
        caps = np.concatenate([toward - open_, toward + open_, lean - wide, lean + wide], axis=2)
        caps = np.mod(caps - angle[..., None], 2 * np.pi) / np.pi
    tidy = lambda t: np.sort(np.concatenate([np.zeros((n, 2 * m, 1)), np.where(np.isfinite(t), np.clip(t, 0, 1), 0), np.ones((n, 2 * m, 1))], axis=2), axis=2)
    out = [np.zeros(n) for _ in range(3)]
    index = np.repeat(np.arange(m), 2)
    of_a, eps = index < ma, 1e-9 * max(1.0, r)
    for cuts, is_cap in ((tidy(sides), False), (tidy(caps), True)):
        t0, t1 = cuts[..., :-1], cuts[..., 1:]
        if is_cap:
            turn = lambda t: angle[..., None] + np.pi * t
            at = lambda t: centre[:, :, None] + r * np.stack([np.cos(turn(t)), np.sin(turn(t))], axis=-1)
            f0, f1 = turn(t0), turn(t1)
            piece = (r * r * (f1 - f0) + r * (centre[..., 0, None] * (np.sin(f1) - np.sin(f0)) - centre[..., 1, None] * (np.cos(f1) - np.cos(f0)))) / 2
        else:
            at = lambda t: origin[:, :, None] + way[:, :, None] * (span[..., None] * t)[..., None]
            piece = cross(at(t0), at(t1)) / 2
        middle = at((t0 + t1) / 2)
        far = to_segment(middle[..., None, 0], middle[..., None, 1], *(ends[:, None, None, :, k, c] for k in (0, 1) for c in (0, 1)))
        mine, first = index[:, None] == np.arange(m), np.arange(m) < index[:, None]
        same = (of_a[:, None] == (np.arange(m) < ma)) & ~mine
        covered = ((far < r - eps) & same[None, :, None] | (np.abs(far - r) <= eps) & (same & first)[None, :, None]).any(axis=3)
        other = np.where(of_a[:, None] == (np.arange(m) < ma), np.inf, 0.0)[None, :, None]
        nearest = (far + other).min(axis=3)
        within = np.where(of_a[None, :, None], nearest <= r + eps, nearest < r - eps)
        piece = np.where(covered, 0, piece)
        out[0] += np.where(within, piece, 0).sum(axis=(1, 2))
        out[1] += piece[:, of_a].sum(axis=(1, 2))
        out[2] += piece[:, ~of_a].sum(axis=(1, 2))
    return out[0], out[1], out[2]


def buffer_shares(a: Lines, b: Lines, radius: float) -> np.ndarray:
    """Per row the area that both surroundings share over the smaller one's; 0 without points."""
    shared, left, right = surroundings(a, b, radius)
    least = np.minimum(left, right)
    return np.clip(np.where(least > 0, shared / np.where(least > 0, least, 1), 0), 0, 1)


# ---------------------------------------------------------------- columns


def buffer_share(radius: float, scale: Scale = (1.0, 1.0)):
    """A column function of two lines: the share of their surroundings. Null for a null line."""

    @F.arrow_udf(T.DoubleType())
    def share(a: pa.Array, b: pa.Array) -> pa.Array:
        return _column(buffer_shares(Lines.read(a, scale), Lines.read(b, scale), radius), a, b)

    return share


def run_share(step: float = 5.0, tolerance: float = 10.0, scale: Scale = (1.0, 1.0)):
    """A column function of two lines: the share of samples in their longest common run. Null for a null line."""

    @F.arrow_udf(T.DoubleType())
    def share(a: pa.Array, b: pa.Array) -> pa.Array:
        return _column(run_shares(Lines.read(a, scale), Lines.read(b, scale), step, tolerance), a, b)

    return share


MATCH = T.StructType([T.StructField("lss", T.DoubleType()), T.StructField("hausdorff", T.DoubleType()), T.StructField("width_change", T.BooleanType()), T.StructField("same_ends", T.BooleanType())])


def line_match(scale: Scale, step: float = 5.0, tolerance: float = 10.0, width: tuple[float, float] = (2.0, 10.0), ends: float = 50.0, only: tuple[str, ...] = ()):
    """A column function of two lines: struct(lss, hausdorff, width_change, same_ends); with `only`, of those measures, and the others are not computed."""
    measures = {"lss": lambda p, q: run_shares(p, q, step, tolerance), "hausdorff": hausdorff, "width_change": lambda p, q: width_changed(p, q, *width), "same_ends": lambda p, q: same_ends(p, q, ends)}
    names = only or tuple(MATCH.names)

    @F.arrow_udf(T.StructType([MATCH[name] for name in names]))
    def match(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = Lines.read(a, scale), Lines.read(b, scale)
        return pa.StructArray.from_arrays([pa.array(measures[name](p, q)) for name in names], names=list(names))

    return match


CLOSE = T.StructType([T.StructField("share", T.DoubleType()), T.StructField("hausdorff", T.DoubleType())])


def line_closeness(scale: Scale, radius: float, most: float):
    """A column function of two lines: struct(share of their surroundings, hausdorff); the share is 0 for lines too far apart."""

    @F.arrow_udf(CLOSE)
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = Lines.read(a, scale), Lines.read(b, scale)
        far = hausdorff(p, q)
        near = np.flatnonzero(far <= most)
        share = np.zeros(len(far))
        one, of = alike(p, q, near)
        share[near] = buffer_shares(picked(p, near[one]), picked(q, near[one]), radius)[of]
        return pa.StructArray.from_arrays([pa.array(share), pa.array(far)], names=CLOSE.names)

    return close


def alike(a: Lines, b: Lines, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in rows that stand for all, which of these stands for each): pairs of straight segments that are one another moved are alike."""
    straight = (a.count[rows] == 2) & (b.count[rows] == 2)
    some = rows[straight]
    corners = np.stack([v[g.at[:-1][some] + k] - o for g in (a, b) for k in (0, 1) for v, o in ((g.x, a.x[a.at[:-1][some]]), (g.y, a.y[a.at[:-1][some]]))], axis=1) if len(some) else np.zeros((0, 8))
    _, first, of = np.unique(corners, axis=0, return_index=True, return_inverse=True)
    stands = np.arange(len(rows))
    stands[straight] = np.flatnonzero(straight)[first][of.reshape(-1)]
    return np.unique(stands, return_inverse=True)


def picked(g: Lines, rows: np.ndarray) -> Lines:
    """Some of the lines."""
    at = np.append(0, np.cumsum(g.count[rows]))
    i = np.repeat(g.at[:-1][rows] - at[:-1], g.count[rows]) + np.arange(at[-1])
    return Lines(g.x[i], g.y[i], at)


def _column(values: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.asarray(a.is_null()) | np.asarray(b.is_null()))
