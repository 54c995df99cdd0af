"""Pairs of shapes are scored once each, and edges read only where a vertex lies in a box."""

import random

from pyspark.sql import functions as F

from chronofeat.functions import geo
from chronofeat.operators import link, matching, overlay


def shapes(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, *(float(rng.randrange(*r)) for r in ((80,), (80,), (5, 30), (5, 30))), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double, h double, confidence double")
    at = lambda p, q: geo.point(F.col("x") + F.col("w") * p, F.col("y") + F.col("h") * q)
    bay = F.array(*[at(p, q) for p, q in ((0, 0), (1, 0), (1, 1), (0.8, 1), (0.8, 0.3), (0.2, 0.3), (0.2, 1), (0, 1), (0, 0))])
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return df.select("id", "confidence", box.alias("box"), F.struct(F.lit("Polygon").alias("gtype"), F.array(F.array(bay)).alias("parts")).alias("geometry"))


def readings(df):
    """Places of a plan where points are held against edges."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if ".geometry.parts, lambda" in line]


def test_pairs_are_scored_once(spark):
    a, b = shapes(spark, 1, 60), shapes(spark, 2, 60)
    found, verified = matching.match_detections(a, b), matching.verify_match(a, b, area_ratio=None)
    assert len(readings(found)) == len(readings(verified)) == 1

    p, q = (overlay.with_shape(df, "_area", "_mean").select(F.struct("*").alias(n)) for df, n in ((a, "a"), (b, "b")))
    x, y = F.col("a"), F.col("b")
    inside = geo.point_in_polygon(x["_mean"]["x"], x["_mean"]["y"], y["geometry"]) | geo.point_in_polygon(y["_mean"]["x"], y["_mean"]["y"], x["geometry"])
    every = p.crossJoin(q).select("a.id", F.col("b.id").alias("other"), "b.confidence", inside.alias("inside"), matching.mean_distance(x, y).alias("d"), (F.least("a._area", "b._area") / F.greatest("a._area", "b._area")).alias("ratio"),
        (F.greatest("a.box.x0", "b.box.x0") <= F.least("a.box.x1", "b.box.x1")).alias("wide"), (F.greatest("a.box.y0", "b.box.y0") <= F.least("a.box.y1", "b.box.y1")).alias("high")).collect()
    best, sure = {}, {}
    for r in every:
        score = 0.8 if r.inside else 0.6 if r.d < 20 else 0.0
        if r.wide and r.high and score:
            best[r.id] = min(best.get(r.id, (0.0, 0)), (-score, r.other))
        total = 0.4 * r.confidence + 0.3 * score + 0.2 * r.ratio + 0.1 * max(0.0, 1 - r.d / 20)
        if score and total >= 0.3:
            sure[r.id] = min(sure.get(r.id, (0.0, 0)), (-round(total, 9), r.other))
    assert {r.id: (-r.score, r.other) for r in found.collect()} == best and len({s for s, _ in best.values()}) == 2
    assert {r.id: (-round(r.combined, 9), r.other) for r in verified.collect()} == sure and len(sure) > 20
