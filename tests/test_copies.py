"""Many rows of one shape: joins of places judge each shape once, with the same results."""

import random

from pyspark.sql import functions as F

from chronofeat.operators import link, spatial


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "y0", "x1", "y1").alias("box"))


def table(n, seed=1):
    rng = random.Random(seed)
    shapes = [(x, y, x + rng.choice((8, 10)), y + 9) for x, y in ((rng.randrange(40), rng.randrange(40)) for _ in range(15))]
    return [(k, *map(float, rng.choice(shapes))) for k in range(n)]


def iou(a, b):
    wide, high = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
    shared = max(wide, 0) * max(high, 0)
    return shared and shared / (sum((r[3] - r[1]) * (r[4] - r[2]) for r in (a, b)) - shared)


def test_duplicate_classes_tell_all_pairs(spark):
    rows = table(90)
    found = link.duplicate_classes(boxes(spark, rows), 0.3, 16.0).collect()
    of = {r.b: r.a for r in found if r.kind == "copy"}
    links = {(r.a, r.b) for r in found if r.kind == "link"}
    assert len(of) == len(rows) - len({r[1:] for r in rows}) and len(found) == len(of) + len(links)
    rep = lambda k: of.get(k, k)
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                p, q = sorted((rep(a[0]), rep(b[0])))
                assert (p == q or (p, q) in links) == (iou(a, b) >= 0.3)


def test_copies_are_settled_once(spark):
    rows = table(60, 2) + [(1000, 5.0, 5.0, 5.0, 9.0), (1001, 5.0, 5.0, 5.0, 9.0)]  # without area: nobody's copies
    df = boxes(spark, rows)
    plain = link.duplicate_groups(df, link.duplicate_pairs(df, 0.3, 16.0)).collect()
    assert {tuple(r) for r in link.duplicate_stars(df, 0.3, cell=16.0).collect()} == {tuple(r) for r in plain}
    ranked = df.withColumn("priority", F.col("id") % 3)
    order = {r[0]: (r[0] % 3, r[0]) for r in rows}
    near = {a[0]: [b[0] for b in rows if a[0] != b[0] and iou(a, b) >= 0.3] for a in rows}
    seed = {}
    for k in sorted(order, key=order.get):
        if k not in seed:
            seed[k] = k
            for m in near[k]:
                seed.setdefault(m, k)
    assert {r.id: r.seed for r in link.duplicate_stars(ranked, 0.3, "priority", 16.0).collect()} == seed


def test_one_place_makes_no_square(spark):
    df = boxes(spark, [(k, 0.0, 0.0, 9.0, 9.0) for k in range(30_000)])
    assert link.duplicate_classes(df, 0.5).groupBy("kind").count().collect()[0]["count"] == 29_999


def test_scores_stay_out_of_the_join(spark):
    pairs = link.duplicate_pairs(boxes(spark, table(5)), 0.3)
    join = next(line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line)
    assert "0.3" not in join and "try_divide" not in join.lower()
    one = spark.range(1).select(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(4).alias("x1"), F.lit(0).alias("y1")).alias("p"))
    assert one.select(spatial.iou(F.col("p"), F.col("p")), spatial.overlap_ratio(F.col("p"), F.col("p"))).first()[:] == (0.0, 0.0)


def test_chains_of_copies(spark):
    from chronofeat.operators import matching

    df = boxes(spark, table(40, 3))
    links = lambda a, b: matching.chain_match(a, b, cell=16.0).select(F.col("id").alias("a"), F.col("other").alias("b"), "iou")
    found = link.linked_classes(df, df, ("id", "id"), links).collect()
    of = {k: {r.b: r.a for r in found if r.kind == k} for k in "ab"}
    pairs = {(r.a, r.b) for r in found if r.kind == "link"}
    plain = {(r.id, r.other) for r in matching.chain_match(df, df, cell=16.0).collect()}
    assert {(a, b) for a in range(40) for b in range(40) if (of["a"].get(a, a), of["b"].get(b, b)) in pairs} == plain


def test_areas_are_looked_at_once_a_class(spark, monkeypatch):
    from chronofeat.functions import geo
    from chronofeat.operators import overlay

    asked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda a: (asked.add(1), a)[1], "double")
    monkeypatch.setitem(overlay.MEASURES, "_area", lambda g: seen(geo.polygon_area(g)))
    shapes = [(0.0, 0.0, 8.0, 8.0), (4.0, 0.0, 12.0, 8.0), (30.0, 0.0, 30.0, 8.0)]  # the last has no area
    rows = boxes(spark, [(k, *shapes[k % 3]) for k in range(300)])
    rows = rows.withColumn("geometry", F.when(F.col("id") % 2 == 0, geo.box(*(F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")))))
    found = link.duplicate_classes(rows, 0.3).collect()
    assert asked.value <= 6
    assert [(r.a, r.b) for r in found if r.kind == "link"] == [(0, 1)] and {(r.a, r.b) for r in found if r.kind == "copy"} == {(k % 3, k) for k in range(3, 300) if k % 3 < 2}
