"""Scalar functions, kernels and small operators on hand-made rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofeat.functions import dates, geo, text, tiles
from chronofeat.operators import evidence, filters, kernels, link, overlay, reports, resolve, roads, sets, spatial
from chronofeat.sources import normalize, readers, sinks
from chronofeat.streaming import edits

YEARS = [
    ("1950", 1950, 1950, 1950), ("~1950", 1950, 1950, 1950), ("ca 1950", 1950, 1950, 1950), ("1950-01-01", 1950, 1950, 1950), ("1950s", 1950, 1950, 1959), ("1950-1960", 1950, 1950, 1960),
    ("19th century", 1800, 1800, 1899), ("1800-tallet", 1850, 1800, 1899), ("middelalder", 1300, 1300, 1300), ("early 1900s", 1900, 1900, 1920), ("mid 1800s", 1805, 1803, 1807), ("late 1800s", 1807, 1807, 1809),
    ("built in 1887, they say", 1887, 1887, 1887), ("1650", None, None, None), ("nothing", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_years(spark):
    df = spark.createDataFrame(YEARS, "value string, year int, a int, b int")
    got = df.select("value", dates.parse_year(F.col("value")).alias("year"), dates.parse_year_range(F.col("value")).alias("r")).collect()
    assert [(r.value, r.year, r.r.start, r.r.end) for r in got] == YEARS


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_small_functions(spark):
    L = F.lit
    assert one(spark, dates.mid_year(L(1840), L(1850)), dates.mid_year(L(1840), L(None).cast("int")), dates.mid_year(L(None).cast("int"), L(1850))) == (1845, 1840, 1850)
    assert one(spark, dates.is_valid_year(L(1880)), dates.is_valid_year(L(1650)), dates.is_valid_year(L(1650), 1600), dates.is_valid_year(L(2050))) == (True, False, True, False)
    assert one(spark, dates.era(L(1850)), dates.era(L(1925)), dates.era(L(1975))) == ("pre_1900", "1900_1950", "post_1950")
    assert one(spark, dates.year_of_registry_date(L("01.02.1950")), dates.year_of_registry_date(L("19500102")), dates.year_of_slashed_date(L("3/14/1931 0:00"))) == (1950, 1950, 1931)
    assert one(spark, text.meets(L("h"), "m"), text.meets(L("m"), "h"), text.meets(L("m"), "m"), text.meets(L("l"), "h")) == (True, False, True, False)
    assert one(spark, text.feature_code(L("sefrak"), L("SEFRAK-12345")), text.feature_code(L("osm"), L("way/123456")), text.feature_code(L("ml_kartverket_1880"), L("ml-detected-001"))) == ("sef-12345", "osm-123456", "ml-detected-001")
    assert one(spark, text.ml_source_code(L("ml_kartverket_1880")), text.ml_source_code(L("ml_aerial_1947")), text.ml_source_code(L("osm"))) == ("kv1880", "air1947", None)
    assert one(spark, text.name_similarity(L("Main St"), L("main st ")), text.name_similarity(L("Main St"), L("Old Main St")), text.name_similarity(L("Mainz"), L("Main St")), text.name_similarity(L(""), L("x"))) == (1.0, 0.7, 0.3, 0.0)
    assert [text.rule_min_evidence(r) for r in (">= high", ">= medium", "new_building_exists")] == ["h", "m", "l"]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = {"gtype": "Polygon", "parts": [[ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]]}
HOLED = {"gtype": "Polygon", "parts": [[ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))]]}
ELL = {"gtype": "Polygon", "parts": [[ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))]]}
SHIFTED = {"gtype": "Polygon", "parts": [[ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))]]}


def test_polygons(spark):
    df = spark.createDataFrame([(SQUARE,), (HOLED,), (ELL,)], f"g {geo.GEOMETRY}")
    got = df.select(geo.polygon_area(F.col("g")), geo.point_in_polygon(F.lit(2.0), F.lit(2.0), F.col("g")), geo.bbox(F.col("g")), geo.area_centroid(F.col("g"))).collect()
    assert [tuple(r)[:2] for r in got] == [(16.0, True), (12.0, False), (7.0, False)]
    assert tuple(got[0][2]) == (0, 0, 4, 4) and tuple(got[0][3]) == (2, 2)
    shapes = spark.createDataFrame([("s", SQUARE), ("h", HOLED), ("l", ELL), ("t", SHIFTED)], f"k string, g {geo.GEOMETRY}")
    both = shapes.alias("p").crossJoin(shapes.alias("q")).select("p.k", F.col("q.k").alias("l"), overlay.shared_area(F.col("p.g"), F.col("q.g")).alias("area"))
    areas = {(r.k, r.l): r.area for r in both.collect()}
    for pair, area in {("s", "s"): 16, ("s", "t"): 4, ("h", "t"): 3, ("l", "t"): 0, ("s", "h"): 12, ("h", "h"): 12, ("l", "h"): 7, ("l", "l"): 7}.items():
        assert areas[pair] == pytest.approx(area) and areas[pair[::-1]] == pytest.approx(area)
    pairs = spark.createDataFrame([(SQUARE, SHIFTED)], f"a {geo.GEOMETRY}, b {geo.GEOMETRY}")
    assert tuple(pairs.select(overlay.overlap_ratio("a", "b"), overlay.iou("a", "b")).first()) == pytest.approx((0.25, 4 / 28))
    assert [kernels.ring_fault(np.array(p, float)) for p in ([(0, 0), (1, 0), (0, 1), (0, 0)], [(0, 0), (1, 0)], [(0, 0), (1, 0), (0, 1), (1, 1)], [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])] == [None, "too short", "open", "crossing"]


def test_simplify():
    assert kernels.simplify(np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], float), 0.5).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_places(spark):
    p = spark.range(1).select(geo.utm32_to_lonlat(F.lit(569_630.0), F.lit(7_034_000.0)).alias("p"), geo.utm32_to_lonlat(F.lit(500_000.0), F.lit(0.0)).alias("q")).first()
    assert 10.38 < p.p.x < 10.42 and 63.41 < p.p.y < 63.44 and tuple(p.q) == pytest.approx((9.0, 0.0))
    t = spark.range(1).select(tiles.lonlat_to_tile(F.lit(10.395), F.lit(63.43), F.lit(12)).alias("t")).select("t", tiles.tile_to_bbox(F.col("t.z"), F.col("t.x"), F.col("t.y")).alias("b"), tiles.quadkey(F.col("t.z"), F.col("t.x"), F.col("t.y")).alias("q")).first()
    assert t.b.x0 <= 10.395 < t.b.x1 and t.b.y0 < 63.43 <= t.b.y1 and len(t.q) == 12
    assert tuple(spark.range(1).select(tiles.quadkey_to_tile(F.lit(t.q)).alias("t")).first().t) == tuple(t.t)
    assert spark.range(1).select(F.size(tiles.neighbours(F.lit(1), F.lit(0), F.lit(0)))).first()[0] == 3
    w = spark.createDataFrame([(100, 50)], "width int, height int")
    assert tiles.raster_windows(w, 40, 10).count() == 6
    assert one(spark, geo.from_wkt(F.lit("LINESTRING Z (1 2 3, 4 5 6)")))[0].parts[0][0][1].x == 4
    assert len(one(spark, geo.from_wkt(F.lit("MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))")))[0].parts) == 2


def test_grid_join_is_brute_force(spark):
    rng = random.Random(1)
    make = lambda n, big: [(i, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.choice([0, 1, 30, big]), y + rng.choice([0, 2, 20])) for i in range(n)]
    a, b = make(120, 400), make(150, 900)
    df = lambda rows: spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    got = [(r[0], r[1]) for r in spatial.box_join(df(a), df(b), 10.0).select("a.id", "b.id").collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_k_is_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(80)]
    d = [(i, rng.choice([rng.uniform(0, 300), rng.uniform(0, 9000)]), rng.uniform(0, 900)) for i in range(60)]
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = {(r.id, r.rank): r.donor for r in spatial.nearest_k(df(a), df(d), 3, 50.0).collect()}
    for i, x, y in a:
        near = sorted((math.hypot(x - p, y - q), k) for k, p, q in d)[:3]
        assert [got[i, n] for n in (1, 2, 3)] == [k for _, k in near]
    assert spatial.nearest_k(df(a), df(d[:2]), 3, 50.0).count() == 160 and spatial.nearest_k(df(a), df(d).limit(0), 3, 50.0).count() == 0


def test_duplicate_groups_are_stars(spark):
    rng = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b})
    got = {r.id: r.seed for r in link.duplicate_groups(spark.range(40), spark.createDataFrame(pairs, "a long, b long")).collect()}
    seeds: dict[int, int] = {}
    for i in range(40):
        first = next((a for a in range(i) if (a, i) in pairs and seeds[a] == a), None)
        seeds[i] = i if first is None else first
    assert got == seeds


def test_estimates(spark):
    rows = [(1, 1, "exact", None, None, 1880, 0.9), (1, 2, "presence", None, 1850, None, 0.9), (2, 1, "presence", None, 1900, None, 0.6), (2, 2, "absence", 1880, None, None, 0.6), (3, 1, "presence", None, 2024, None, 0.6), (4, 1, "exact", None, None, 1900, 0.5), (5, 1, "presence", None, 1850, None, 0.5), (5, 2, "absence", 1900, None, None, 0.5)]
    ev = spark.createDataFrame(rows, "building_id long, source_id long, evidence_type string, min_year int, max_year int, exact_year int, confidence double").withColumn("end_year", F.lit(None).cast("int"))
    got = {r.building_id: r for r in evidence.best_estimate(ev, spark.createDataFrame([(1, 0), (2, 1)], "source_id long, priority int"), 2025).collect()}
    assert [(got[i].start_year, got[i].method, got[i].confidence) for i in range(1, 6)] == [(1880, "exact", 0.9), (1890, "range", 0.74), (None, "unknown", 0.0), (1900, "range", 0.72), (1875, "range", 0.54)]


def test_replacement_and_roads(spark):
    rows = [(1, 0, 0, 10, 10, 1880, None, "m"), (2, 1, 1, 11, 11, 1950, None, "h"), (3, 0, 0, 10, 10, None, None, "l"), (4, 100, 0, 110, 10, 1960, None, "l"), (5, 101, 1, 111, 11, None, None, "l")]
    df = spark.createDataFrame(rows, "id long, x0 int, y0 int, x1 int, y1 int, sd int, ed int, ev string").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    got = {r.id: (r.repl_by, r.ed) for r in resolve.detect_replacements(df).collect()}
    assert got == {1: (2, 1950), 2: (3, None), 3: (None, None), 4: (5, None), 5: (None, None)}
    cross = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 10, 10, 0), (3, 20, 0, 30, 0)], "id long, x0 int, y0 int, x1 int, y1 int")
    assert sorted((r.id, r.part, r.x1) for r in roads.split_at_crossings(cross).collect()) == [(1, 0, 5.0), (1, 1, 10.0), (2, 0, 5.0), (2, 1, 10.0), (3, 0, 30.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "kart.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}},{"type":"Feature","properties":{},"geometry":null}]}')
    rows = readers.read_dir_with_source(spark, str(tmp_path)).collect()
    assert [(r.src, r.properties, r.geometry.gtype, len(r.geometry.parts[0][0])) for r in rows] == [("kart", {"a": "1"}, "Polygon", 4)]
    df = spark.createDataFrame([("osm", 1900, SQUARE)], f"src string, sd int, geometry {geo.GEOMETRY}")
    sinks.write_features(df, str(tmp_path / "out"), "geojson")
    back = readers.read_geojson_lines(spark, str(tmp_path / "out")).first()
    assert back.properties == {"src": "osm", "sd": "1900"} and back.geometry.asDict(recursive=True) == SQUARE
    (tmp_path / "osm.json").write_text('{"elements":[{"type":"node","id":1,"lon":0,"lat":0},{"type":"node","id":2,"lon":1,"lat":0},{"type":"node","id":3,"lon":1,"lat":1},{"type":"node","id":4,"lon":0,"lat":1},{"type":"way","id":9,"nodes":[1,2,3,4],"tags":{"building":"yes","start_date":"1890s"}},{"type":"relation","id":7,"members":[{"type":"way","ref":9,"role":"outer"}],"tags":{}}]}')
    nodes, ways, relations = readers.read_osm_elements(spark, str(tmp_path / "osm.json"))
    shapes = normalize.assemble_ways(ways, nodes)
    got = normalize.normalize_osm(shapes).first()
    assert (got.src_id, got.sd, got.ev, got.bt, len(got.geometry.parts[0][0])) == ("way/9", 1890, "h", "yes", 5)
    assert normalize.assemble_relations(relations, shapes).first().geometry.gtype == "Polygon"
    reg = spark.createDataFrame([("S1", "1840", "1850", "Våningshus", None, None, "0", 569_630.0, 7_034_000.0), ("", "1840", None, None, None, None, None, 1.0, 1.0)], "sefrak_id string, start_date string, end_date string, original_function_name string, current_function_name string, bygningstype string, sefrak_status string, easting double, northing double").withColumn("name", F.lit("x"))
    good, bad = normalize.normalize_registry(reg)
    assert [(r.src_id, r.sd, r.bt, r.demolished) for r in good.collect()] == [("S1", 1845, "residential", True)] and [r.reason for r in bad.collect()] == ["no_id"]
    assert one(spark, normalize.decode_time_code(F.lit("184")))[0].label == "1840-1850"


def test_validation_modes(spark):
    df = spark.createDataFrame([("a", "h"), (None, "x")], "src_id string, ev string").withColumn("geometry", F.lit("g"))
    assert normalize.validate(df, "drop", **normalize.building_rules()).count() == 1
    assert {r.reason: r.n for r in normalize.reject_counts(normalize.validate(df, "mark", **normalize.building_rules())).collect()} == {"src_id": 1, "ev": 1}
    with pytest.raises(Exception, match="broken rules"):
        normalize.validate(df, "fail", **normalize.building_rules()).collect()


def test_edit_stream(spark, tmp_path):
    """Late, repeated and returning keys over several runs of one query each."""
    schema = "event_id long, fid long, edited_at timestamp, sd int"
    place = lambda x: str(tmp_path / x)
    stream = lambda: spark.readStream.schema(schema).parquet(place("in"))
    runs = [[(1, 7, 100, 1900), (2, 8, 100, 1901)], [(3, 7, 200, 1950), (4, None, 200, 1), (5, 9, 300, 1)], [(6, 7, 150, 1800), (1, 7, 100, 1900), (7, 8, 90_000, None), (7, 8, 90_000, None)]]
    for batch in runs:
        df = spark.createDataFrame(batch, "event_id long, fid long, edited_at long, sd int").withColumn("edited_at", F.timestamp_seconds("edited_at"))
        df.coalesce(1).write.mode("append").parquet(place("in"))
        edits.merge_edits(stream(), place("out"), place("state")).awaitTermination()
        edits.dedup_ingest(stream(), "fid", "event_id", place("first"), place("state2")).awaitTermination()
        edits.process_once(stream(), "fid", lambda d: d.where("fid IS NOT NULL"), place("once"), place("state3"), ("event_id",)).awaitTermination()
    assert sorted((r.fid, r.event_id, r.sd, r.ev) for r in edits.snapshot(spark, place("out")).collect()) == [(7, 3, 1950, "h"), (8, 7, None, "h"), (9, 5, 1, "h")]
    assert sorted((r.event_id, r.fid) for r in edits.results(spark, place("first")).collect()) == [(1, 7), (2, 8), (4, None), (5, 9)]
    assert sorted((r.event_id, r.fid) for r in edits.results(spark, place("once")).collect()) == [(1, 7), (2, 8), (5, 9)]
    changed = [r.fid for r in spark.read.parquet(place("out/2")).collect()]
    assert changed == [8]  # a run writes what it changes
    assert edits.snapshot(spark, place("none")) is None


def test_sets_and_reports(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, None, 2)], "id long, code string, at int")
    assert sorted(r.id for r in sets.dedup_keep_first(df, "code", "at").collect()) == [2, 3, 4]
    assert sorted(r.id for r in sets.dedup_keep_last(df, "code", "at").collect()) == [1, 3, 4]
    assert sets.dedup_by_content(df.select("code"), ["code"]).count() == 2
    assert sets.even_sample(spark.range(100), 10, "id").count() == 10
    assert sets.new_only(df, df.withColumn("id", F.col("id") + 2), "id").count() == 6
    gcps = spark.createDataFrame([("m", 0.0, 0.0, 10.0, 64.0), ("m", 100.0, 100.0, 11.0, 63.0)], "map_id string, pixel_x double, pixel_y double, geo_x double, geo_y double")
    assert tuple(reports.gcp_bounds(gcps, spark.createDataFrame([("m", 200, 100)], "map_id string, width int, height int")).first()) == pytest.approx(("m", 10.0, 63.0, 12.0, 64.0))
    seen = spark.createDataFrame([(1, 1880, True, 0.5), (1, 1904, True, 0.7), (1, 1947, False, 0.9)], "id long, map_year int, found boolean, confidence double")
    assert tuple(resolve.fold_detections(seen).first()) == (1, 3, 2, 1880, 0.7, "m")
    visible = spark.createDataFrame([("osm", 1900, None), ("osm", None, None)], "src string, sd int, ed int")
    assert filters.filter_sources(visible, []).count() == 0 and filters.filter_sources(visible, None).count() == 2 and filters.as_of(visible, 1850).count() == 1
