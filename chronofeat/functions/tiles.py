"""Map tiles: slippy numbering, quadkeys and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the girth of the web map's square world in metres.
WORLD = math.pi * 6_378_137.0


def lonlat_to_tile(lon: Column, lat: Column, zoom: Column) -> Column:
    """struct(z, x, y) of the tile that holds a place."""
    n = F.pow(F.lit(2.0), zoom)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    hold = lambda v: F.least(F.greatest(v, F.lit(0)), (n - 1).cast("long")).cast("long")
    return F.struct(zoom.cast("int").alias("z"), hold(x).alias("x"), hold(y).alias("y"))


def tile_to_bbox(z: Column, x: Column, y: Column) -> Column:
    """struct(x0, y0, x1, y1) in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return F.struct((x / n * 360 - 180).alias("x0"), lat(y + 1).alias("y0"), ((x + 1) / n * 360 - 180).alias("x1"), lat(y).alias("y1"))


def tile_to_meters(z: Column, x: Column, y: Column) -> Column:
    """struct(x0, y0, x1, y1) in web map metres."""
    side = 2 * WORLD / F.pow(F.lit(2.0), z)
    return F.struct((x * side - WORLD).alias("x0"), (WORLD - (y + 1) * side).alias("y0"), ((x + 1) * side - WORLD).alias("x1"), (WORLD - y * side).alias("y1"))


def tile_centre(z: Column, x: Column, y: Column) -> Column:
    b = tile_to_bbox(z, x, y)
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def quadkey(z: Column, x: Column, y: Column) -> Column:
    """One digit a level: 1 for the eastern half, 2 more for the southern."""
    bit = lambda v, i: F.floor(v / F.pow(F.lit(2.0), z - i)) % 2
    digit = lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string")
    return F.when(z > 0, F.array_join(F.transform(F.sequence(F.lit(1), z.cast("int")), digit), "")).otherwise("")


def quadkey_to_tile(key: Column) -> Column:
    """struct(z, x, y) of a quadkey."""
    digits = F.filter(F.split(key, ""), lambda c: c != "")
    bit = lambda c, k: F.floor(c.cast("long") / k) % 2
    fold = lambda k: F.aggregate(digits, F.lit(0).cast("long"), lambda t, c: t * 2 + bit(c, k))
    return F.struct(F.char_length(key).alias("z"), fold(1).alias("x"), fold(2).alias("y"))


def neighbours(z: Column, x: Column, y: Column) -> Column:
    """The up to eight tiles around one, held to the world."""
    n = F.pow(F.lit(2.0), z).cast("long")
    around = F.array(*[F.struct(z.alias("z"), (x + dx).alias("x"), (y + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    return F.filter(around, lambda t: t["x"].between(0, n - 1) & t["y"].between(0, n - 1))


def tiles_of_bbox(df: DataFrame, zoom: int, bounds: str = "bounds") -> DataFrame:
    """df once for each tile that its bounds touch, as column `tile`."""
    b, z = F.col(bounds), F.lit(zoom)
    low, high = lonlat_to_tile(b["x0"], b["y1"], z), lonlat_to_tile(b["x1"], b["y0"], z)
    out = df.withColumn("_x", F.explode(F.sequence(low["x"], high["x"]))).withColumn("_y", F.explode(F.sequence(low["y"], high["y"])))
    return out.withColumn("tile", F.struct(z.alias("z"), F.col("_x").alias("x"), F.col("_y").alias("y"))).drop("_x", "_y")


def metre_grid(df: DataFrame, size_m: float, bounds: str = "bounds", metric: tuple[float, float] = (50_000.0, 111_000.0)) -> DataFrame:
    """df once for each tile of size_m metres over its bounds: row, col and the tile's bounds held to them."""
    b, (mx, my) = F.col(bounds), metric
    count = lambda a, z, m: F.greatest(F.ceil((b[z] - b[a]) * m / size_m), F.lit(1)).cast("int")
    out = df.withColumn("row", F.explode(F.sequence(F.lit(0), count("y0", "y1", my) - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), count("x0", "x1", mx) - 1)))
    edge = lambda k, start, end, m: F.least(b[start] + k * (size_m / m), b[end])
    r, c = F.col("row"), F.col("col")
    return out.withColumn("tile", F.struct(edge(c, "x0", "x1", mx).alias("x0"), edge(r, "y0", "y1", my).alias("y0"), edge(c + 1, "x0", "x1", mx).alias("x1"), edge(r + 1, "y0", "y1", my).alias("y1")))


def point_grid(df: DataFrame, step: float, bounds: str = "bounds") -> DataFrame:
    """df once for each grid point over its bounds, as columns x and y."""
    b = F.col(bounds)
    steps = lambda a, z: F.sequence(F.lit(0), F.floor((b[z] - b[a]) / step).cast("int"))
    out = df.withColumn("_i", F.explode(steps("x0", "x1"))).withColumn("_j", F.explode(steps("y0", "y1")))
    return out.withColumn("x", b["x0"] + F.col("_i") * step).withColumn("y", b["y0"] + F.col("_j") * step).drop("_i", "_j")


def raster_windows(df: DataFrame, size: int, overlap: int, width: str = "width", height: str = "height") -> DataFrame:
    """df once for each window of `size` pixels, `overlap` shared with the next; a window under half the size at an edge is left out."""
    step = size - overlap
    at = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(step)), lambda k: k), lambda k: (F.col(n) - k) * 2 >= size)
    out = df.withColumn("px", F.explode(at(width))).withColumn("py", F.explode(at(height)))
    return out.withColumn("pw", F.least(F.lit(size), F.col(width) - F.col("px"))).withColumn("ph", F.least(F.lit(size), F.col(height) - F.col("py")))
