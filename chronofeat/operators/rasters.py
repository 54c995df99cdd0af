"""Footprints against masks of pixels: polygons filled into runs of pixels, runs met by tile and row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import overlay, spatial

RUN = "tile {tile}, row long, first long, last long"


def runs_of(geometry: pa.Array, bounds: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, row, first, last) of the pixels whose centres lie in each polygon (even-odd, lower edges included), by a raster of its own each.

    bounds are x0, y0, x1, y1 a polygon; rows count from the north. Every edge is cut with the
    centre lines of the rows that it reaches; between an odd cut and the next lies a run.
    """
    rings = overlay.Rings(geometry)
    n = len(rings.x)
    after = np.arange(1, n + 1)
    full = np.diff(rings.points_at) > 0
    after[rings.points_at[1:][full] - 1] = rings.points_at[:-1][full]
    row_of_ring = np.repeat(np.arange(len(geometry)), np.diff(rings.rings_at))
    of = np.repeat(row_of_ring, np.diff(rings.points_at))
    x0, y0, x1, y1 = rings.x, rings.y, rings.x[after], rings.y[after]
    tall = (bounds[:, 3] - bounds[:, 1]) / height
    # rows whose centre y = top - (row + 1/2) * tall has low <= y < high
    top, step = bounds[of, 3], tall[of]
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    begin = np.maximum(np.floor((top - high) / step - 0.5) + 1, 0).astype(np.int64)
    end = np.minimum(np.floor((top - low) / step - 0.5), height[of] - 1).astype(np.int64)
    counts = np.maximum(end - begin + 1, 0)
    edge = np.repeat(np.arange(n), counts)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[edge]
    y = top[edge] - (row + 0.5) * step[edge]
    hit = (y0[edge] > y) != (y1[edge] > y)  # the rounding of begin and end decides nothing
    edge, row, y = edge[hit], row[hit], y[hit]
    x = x0[edge] + (y - y0[edge]) * ((x1[edge] - x0[edge]) / (y1[edge] - y0[edge]))
    order = np.lexsort((x, row, of[edge]))
    shape, row, x = of[edge][order], row[order], x[order]
    shape, row, left, right = shape[::2], row[::2], x[::2], x[1::2]
    wide = ((bounds[:, 2] - bounds[:, 0]) / width)[shape]
    place = lambda v: np.ceil((v - bounds[shape, 0]) / wide - 0.5).astype(np.int64)
    first, last = np.maximum(place(left), 0), np.minimum(place(right) - 1, width[shape] - 1)
    some = first <= last
    return shape[some], row[some], first[some], last[some]


def footprint_runs(shapes: DataFrame, tiles: DataFrame, cell: float = 512.0) -> DataFrame:
    """(id, tile, row, first, last): pixels of shapes (id, box, geometry) on the tiles (tile, box, width, height) that their boxes touch.

    A pixel belongs to a polygon if its centre does; what lies outside a tile is not there. Runs of
    one row of a polygon don't overlap. Rows without a geometry have no pixels.
    """
    found = spatial.box_join(shapes.select("id", "box", "geometry"), tiles.select("tile", "box", "width", "height"), cell).where("a.geometry IS NOT NULL")
    rows = found.select("a.id", "b.tile", "a.geometry", *[F.col(f"b.box.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("b.width").cast("long").alias("width"), F.col("b.height").cast("long").alias("height"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
            bounds = np.stack([number(c) for c in ("x0", "y0", "x1", "y1")], axis=1)
            shape, *run = runs_of(batch.column("geometry"), bounds, number("width"), number("height"))
            at = pa.array(shape)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column("id"), at), pc.take(batch.column("tile"), at), *map(pa.array, run)], ["id", "tile", "row", "first", "last"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(fill, f"id {kind('id')}, {RUN.format(tile=kind('tile'))}")


def merged_runs(runs: DataFrame) -> DataFrame:
    """(tile, row, first, last): the pixels of all runs as the fewest runs; a row of a tile has no more than its width."""
    row = Window.partitionBy("tile", "row").orderBy("first", "last")
    before = F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0)
    marked = runs.select("tile", "row", "first", "last").distinct().withColumn("new", new).withColumn("island", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("tile", "row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def runs_from_pixels(pixels: DataFrame) -> DataFrame:
    """(tile, row, first, last) of a table of pixels (tile, row, col) that are on, each once or more."""
    return merged_runs(pixels.select("tile", "row", F.col("col").alias("first"), F.col("col").alias("last")))


def presence(footprints: DataFrame, masks: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, tile, pixels, share, existed, confidence): of each footprint the tile where most of it is on.

    footprints come from footprint_runs, masks from merged_runs. Of tiles with equal shares the one
    with more pixels counts, then the smaller name. Confidence grows from a half with the distance
    of the share from `least`. A footprint without pixels has no row.
    """
    size = footprints.groupBy("id", "tile").agg(F.sum(F.col("last") - F.col("first") + 1).alias("pixels"))
    mask = masks.select("tile", "row", F.col("first").alias("from"), F.col("last").alias("to"))
    both = F.least("last", "to") - F.greatest("first", "from") + 1
    on = footprints.join(mask, ["tile", "row"]).where(both > 0).groupBy("id", "tile").agg(F.sum(both).alias("on"))
    shares = size.join(on, ["id", "tile"], "left").withColumn("share", F.coalesce("on", F.lit(0)) / F.col("pixels"))
    best = shares.groupBy("id").agg(F.min_by(F.struct("tile", "pixels", "share"), F.struct(-F.col("share"), -F.col("pixels"), F.col("tile"))).alias("m")).select("id", "m.*")
    return best.withColumn("existed", F.col("share") >= least).withColumn("confidence", 0.5 + F.abs(F.col("share") - least))
