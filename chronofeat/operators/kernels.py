"""Numeric kernels on candidate pairs, as Arrow-backed pandas UDFs: what column expressions cannot say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import GEOMETRY

# ---------------------------------------------------------------- lines


def to_segments(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of a line's segments."""
    if len(line) == 1:
        return np.hypot(*(p - line[0]).T)
    a, d = line[:-1], line[1:] - line[:-1]
    length = (d * d).sum(axis=1)
    t = ((p[:, None] - a) * d).sum(axis=2) / np.where(length > 0, length, 1)
    near = a + np.clip(t, 0, 1)[..., None] * d
    return np.hypot(*np.moveaxis(p[:, None] - near, 2, 0)).min(axis=1)


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Fewer points of a line, none dropped that lies farther than the tolerance from what is left."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(p) - 1)]
    while open_spans:
        s, e = open_spans.pop()
        if e - s < 2:
            continue
        off = to_segments(p[s + 1 : e], p[[s, e]])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[s + 1 + k] = True
            open_spans += [(s, s + 1 + k), (s + 1 + k, e)]
    return p[keep]


def ring_fault(p: np.ndarray) -> str | None:
    """Why a ring isn't valid: too short, open, or crossing itself; null if it is."""
    if len(p) < 4:
        return "too short"
    if (p[0] != p[-1]).any():
        return "open"
    a, b = p[:-1], p[1:]
    turn = lambda o, u, v: np.sign((u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0]))
    for i in range(len(a) - 2):
        j = np.arange(i + 2, len(a) - (i == 0))
        cross = (turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], np.broadcast_to(a[i], a[j].shape)) * turn(a[j], b[j], np.broadcast_to(b[i], a[j].shape)) < 0)
        if cross.any():
            return "crossing"
    return None


# ---------------------------------------------------------------- columns


def simplified(tolerance: float, scale: tuple[float, float] = (1.0, 1.0)):
    """A pandas UDF of a geometry: each ring or line simplified by a tolerance in metres; a ring's ends stay its ends. Null stays null."""

    def one(ring) -> list[dict]:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        kept = simplify(p * scale, tolerance) / scale if len(p) > 2 else p
        return [{"x": x, "y": y} for x, y in kept.tolist()]

    @F.pandas_udf(GEOMETRY)
    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = [None if kind is None else [[one(ring) for ring in part] for part in parts] for kind, parts in zip(g["gtype"], g["parts"], strict=True)]
        return pd.DataFrame({"gtype": g["gtype"], "parts": parts})

    return run


@F.pandas_udf(T.StringType())
def geometry_fault(g: pd.DataFrame) -> pd.Series:
    """The fault of a polygon's first faulty ring: too short, open, crossing; null for none, and for other geometries."""

    def first(kind, parts):
        if kind not in ("Polygon", "MultiPolygon"):
            return None
        rings = (np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2) for part in parts for ring in part)
        return next((fault for p in rings if (fault := ring_fault(p))), None)

    return pd.Series([first(*x) for x in zip(g["gtype"], g["parts"], strict=True)], dtype=object)
