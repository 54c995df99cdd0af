"""Registered queries of readers, map elements, snapshots, streams, grids and geometry kernels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, text, tiles
from ..lineage import shared
from ..operators import evidence, filters, kernels, lines, resolve, roads
from ..sources import normalize, readers, sinks
from ..streaming import edits
from .registry import Views, query

#: Rows of one document of the files that reader queries write and read again.
PAGE = 500


def _documents(v: Views, rows: DataFrame, key: str, head: str, body: str, tail: str) -> str:
    """The path of a folder with one JSON document a file, each of the rows of PAGE successive keys: head, the column `body` joined, tail."""
    path = f"{shared(v.spark)}/documents-{uuid.uuid4().hex}"
    pages = rows.groupBy(F.floor(F.col(key) / PAGE).alias("page")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(body), ","), F.lit(tail)).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _named(v: Views, rows: DataFrame, ending: str) -> str:
    """The path of a folder with the documents of rows (name, value), each a file called name and ending; names may have folders."""
    path = f"{shared(v.spark)}/documents-{uuid.uuid4().hex}"
    sinks.write_documents(rows.select("name", "value"), path, ending)
    return path


def _box_of(v: Views, name: str) -> DataFrame:
    return v(name).withColumn("geometry", geo.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))


# ---------------------------------------------------------------- readers and sinks


@query("SELECT ord AS id, src, CAST(x0 AS DOUBLE) AS gx, CAST(y1 AS DOUBLE) AS gy, CAST(5 AS BIGINT) AS n FROM base_features WHERE ord % 7 <> 0")
def a1_read_geojson(v):
    """Feature collections, some features without a geometry, as the reader gives them."""
    rows = _box_of(v, "base_features").select("ord", "src", F.when(F.col("ord") % 7 > 0, F.col("geometry")).alias("geometry"))
    lines = rows.withColumn("value", sinks.feature_text(rows))
    found = readers.read_geojson(v.spark, _documents(v, lines, "ord", '{"type":"FeatureCollection","features":[', "value", "]}"))
    ring = F.col("geometry.parts")[0][0]
    return found.select(F.col("properties")["ord"].cast("long").alias("id"), F.col("properties")["src"].alias("src"), ring[0]["x"].alias("gx"), ring[2]["y"].alias("gy"), F.size(ring).cast("long").alias("n"))


@query("SELECT id, rt, sd, CAST(x1 AS DOUBLE) AS gx FROM roads")
def a11_geojson_lines(v):
    """The feature table as lines of GeoJSON, read again."""
    path = f"{shared(v.spark)}/lines-{uuid.uuid4().hex}"
    line = F.struct(F.lit("LineString").alias("gtype"), F.array(F.array(F.array(geo.point(F.col("x0"), F.col("y0")), geo.point(F.col("x1"), F.col("y1"))))).alias("parts"))
    sinks.write_features(v("roads").select("id", "rt", "sd", line.alias("geometry")), path, "geojson")
    p = F.col("properties")
    return readers.read_geojson_lines(v.spark, path).select(p["id"].cast("long").alias("id"), p["rt"].alias("rt"), p["sd"].cast("int").alias("sd"), F.col("geometry.parts")[0][0][1]["x"].alias("gx"))


@query("SELECT kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind FROM part) GROUP BY kind")
def a2_read_osm_elements(v):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation")
    element = F.to_json(F.struct(kind.alias("type"), k.alias("id"), F.when(k % 3 == 0, 10.5).alias("lon"), F.when(k % 3 == 0, 63.5).alias("lat"), F.when(k % 3 == 1, F.array(k, k + 1)).alias("nodes"), F.create_map(F.lit("name"), "p_name").alias("tags")))
    found = readers.read_osm_elements(v.spark, _documents(v, v.table("part").select(k, element.alias("value")), "p_partkey", '{"elements":[', "value", "]}"))
    each = [df.select(F.lit(name).alias("kind"), "id") for name, df in zip(("node", "way", "relation"), found, strict=True)]
    return each[0].union(each[1]).union(each[2]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("SELECT p_partkey AS id, CAST(p_size % 2 AS VARCHAR) AS status, p_brand AS function, CAST(1660 + p_size AS INT) AS code FROM part")
def a3_read_registry_xml(v):
    path = f"{shared(v.spark)}/registry-{uuid.uuid4().hex}"
    rows = v.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).cast("string").alias("status"), F.col("p_brand").alias("function"), (1660 + F.col("p_size")).cast("int").alias("code"))
    rows.write.format("xml").option("rootTag", "collection").option("rowTag", "building").save(path)
    return readers.read_registry_xml(v.spark, path, "building", "id long, status string, function string, code int")


@query("SELECT p_partkey AS id, concat('F', CAST(p_size AS VARCHAR)) AS category, CAST(p_size AS DOUBLE) AS length, CASE WHEN p_size % 2 = 0 THEN 'LineString' ELSE 'MultiLineString' END AS gtype, CAST(p_size + 1 AS DOUBLE) AS gx FROM part")
def a4_read_nvdb(v):
    size = F.col("p_size")
    wkt = F.when(size % 2 == 0, F.concat(F.lit("LINESTRING Z ("), size + 1, F.lit(" 2 3, 4 5 6)"))).otherwise(F.concat(F.lit("MULTILINESTRING (("), size + 1, F.lit(" 2, 3 4), (5 6, 7 8))")))
    one = F.struct(F.col("p_partkey").alias("id"), F.array(F.struct(F.lit("kategori").alias("navn"), F.concat(F.lit("F"), size).alias("verdi"))).alias("egenskaper"), F.struct(size.cast("double").alias("lengde")).alias("lokasjon"), F.struct(wkt.alias("wkt")).alias("geometri"))
    found = readers.read_nvdb(v.spark, _documents(v, v.table("part").select("p_partkey", F.to_json(one).alias("value")), "p_partkey", '{"objekter":[', "value", "]}"))
    return found.select(F.col("nvdb_id").alias("id"), F.col("properties")["kategori"].alias("category"), "length", "geometry.gtype", F.col("geometry.parts")[0][0][0]["x"].alias("gx"))


@query("SELECT o_orderkey AS code, o_orderstatus AS status FROM orders")
def a5_read_pages(v):
    one = F.to_json(F.struct(F.col("o_orderkey").alias("code"), F.col("o_orderstatus").alias("status")))
    return readers.read_pages(v.spark, _documents(v, v.table("orders").select("o_orderkey", one.alias("value")), "o_orderkey", "[", "value", "]"), "code long, status string")


_SERIES = "SELECT o_orderkey AS code, o_custkey % 7 AS series, o_orderkey // 400 AS page FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey // 400 % 5 < 4"


@query(f"""WITH o AS ({_SERIES}), s AS (SELECT series, page, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT *, min(n) OVER e AS least, sum(n) OVER e AS total, page - row_number() OVER (PARTITION BY series ORDER BY page) AS gap, min(page) OVER (PARTITION BY series) AS first FROM s WINDOW e AS (PARTITION BY series ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT code, series FROM o JOIN w USING (series, page) WHERE coalesce(least >= 9, true) AND coalesce(total <= 60, true) AND gap = first - 1""")
def a5_page_series(v):
    """Pages of several series, some short, some missing; each series stops there or after more than 60 rows."""
    key = F.col("o_orderkey")
    page = F.floor(key / 400)
    rows = v.table("orders").where((key % 2 == 0) | (page % 5 < 4)).select(F.concat(F.lit("orders"), F.col("o_custkey") % 7, F.lit("-"), page).alias("name"), F.to_json(F.struct(key.alias("code"), (F.col("o_custkey") % 7).alias("series"))).alias("one"))
    documents = rows.groupBy("name").agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("value"))
    return readers.read_pages(v.spark, _named(v, documents, ".json"), "code long, series long", size=9, cap=60)


@query("SELECT concat('source', CAST(s_suppkey AS STRING)) AS source_id, s_nationkey AS record_count, concat('n', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS path FROM supplier WHERE s_suppkey % 10 > 0")
def a7_discover_sources(v):
    """A manifest a supplier, in a folder of its nation; some name no source."""
    key = F.col("s_suppkey")
    body = F.to_json(F.struct(F.when(key % 10 > 0, F.concat(F.lit("source"), key)).alias("source_id"), F.col("s_nationkey").alias("record_count")))
    rows = v.table("supplier").select(F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit("/manifest")).alias("name"), body.alias("value"))
    root = _named(v, rows, ".json")
    return readers.discover_sources(v.spark, root).select("source_id", "record_count", F.regexp_extract("path", r"(n\d+/s\d+)$", 1).alias("path"))


@query("SELECT concat('kart.', CAST(sd // 10 AS STRING)) AS src, CAST(id AS STRING) AS id, CAST(x AS DOUBLE) AS x FROM registry_points WHERE id % 9 > 0")
def a9_read_folder(v):
    """A file a decade, whose name is the source; some features have no geometry."""
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"id": '), F.col("id").cast("string"), F.lit('}, "geometry": '), F.when(F.col("id") % 9 > 0, F.concat(F.lit('{"type": "Point", "coordinates": ['), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit("]}"))).otherwise("null"), F.lit("}"))
    rows = v("registry_points").select(F.concat(F.lit("kart."), F.floor(F.col("sd") / 10)).alias("name"), feature.alias("one"))
    documents = rows.groupBy("name").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("one"), ", "), F.lit("]}")).alias("value"))
    found = readers.read_dir_with_source(v.spark, _named(v, documents, ".geojson"))
    return found.select("src", F.col("properties")["id"].alias("id"), geo.points(F.col("geometry"))[0]["x"].alias("x"))


@query("SELECT CAST(ord AS STRING) AS ord, CAST(x0 AS DOUBLE) AS gx, CAST(y1 AS DOUBLE) AS gy FROM base_features WHERE ord % 7 > 0")
def a1_read_large_geojson(v):
    """FeatureCollections of many features in one line, split at the features."""
    rows = v("base_features").withColumn("geometry", F.when(F.col("ord") % 7 > 0, geo.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))
    corner = lambda k: F.concat(*[x for n in k for x in (F.lit("["), F.col(n[0]).cast("string"), F.lit(","), F.col(n[1]).cast("string"), F.lit("],"))][:-1], F.lit("]"))
    ring = corner([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")])
    shape = F.when(F.col("geometry").isNotNull(), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))).otherwise("null")
    one = F.concat(F.lit('{"type":"Feature","properties":{"ord":'), F.col("ord").cast("string"), F.lit('},"geometry":'), shape, F.lit("}"))
    path = _documents(v, rows.select("ord", one.alias("value")), "ord", '{"type":"FeatureCollection","features":[', "value", "]}")
    found = readers.read_large_geojson(v.spark, path)
    points = geo.points(F.col("geometry"))
    return found.select(F.col("properties")["ord"].alias("ord"), points[0]["x"].alias("gx"), points[2]["y"].alias("gy"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'MultiLineString' WHEN id % 3 = 1 THEN 'LineString' ELSE 'Point' END AS gtype, CAST(CASE WHEN id % 3 = 2 THEN y1 ELSE y0 END AS DOUBLE) AS gy FROM roads WHERE id % 5 <> 2 OR id % 3 <> 2")
def a6_from_esri(v):
    k, d = F.col("id"), lambda *c: F.array(*(F.col(x).cast("double") for x in c))
    path = F.array(d("x0", "y0"), d("x1", "y1"))
    paths = F.when(k % 3 == 0, F.array(path, path)).when(k % 3 == 1, F.array(path))
    shape = geo.from_esri(paths, F.when(k % 5 != 2, F.col("x1").cast("double")), F.col("y1").cast("double"))
    return v("roads").select("id", shape.alias("g")).where("g IS NOT NULL").select("id", "g.gtype", F.col("g.parts")[0][0][0]["y"].alias("gy"))


@query("SELECT ord, CASE WHEN src = 'osm' THEN 2 ELSE 1 END AS priority, src, sd FROM base_features")
def a8_load_enabled(v):
    catalog = v.spark.createDataFrame([("osm", "osm", 2, True), ("matrikkelen", "matrikkelen", 1, True), ("all", "%", 3, False)], "src string, path string, priority int, enabled boolean")
    return readers.load_enabled(catalog, lambda path: v("base_features").where(F.col("src").like(path)).select("ord", "sd")).select("ord", "priority", "src", "sd")


@query("SELECT src, ev, count(*) AS n FROM base_features GROUP BY src, ev")
def a13_write_report(v):
    path = f"{shared(v.spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(v("base_features").groupBy("src", "ev").agg(F.count("*").alias("n")), path)
    return v.spark.read.schema("src string, ev string, n long").json(path)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 0 THEN 'new' WHEN p_partkey % 4 > 0 THEN 'old' END AS nm, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 = 0 THEN 'g0' WHEN p_partkey % 2 = 0 THEN 'g1' END AS geometry FROM part")
def a14_patch(v):
    """Known rows keep their geometry where they have one; other new values that are there replace old ones."""
    k, part = F.col("p_partkey"), v.table("part")
    old = part.where(k % 4 > 0).select(k.alias("id"), F.lit("old").alias("nm"), F.when(k % 3 == 0, "g0").alias("geometry"))
    new = part.where(k % 2 == 0).select(k.alias("id"), F.when(k % 5 > 0, "new").alias("nm"), F.lit("g1").alias("geometry"))
    return evidence.patch(old, new, "id", ("geometry",))


@query("""SELECT o_orderkey AS building_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1850 + o_orderkey % 100 WHEN o_orderkey % 3 = 0 THEN 1700 END AS INT) AS est_start_year, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS DOUBLE) AS est_confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'range' END AS est_method FROM orders""")
def a16_apply_estimates(v):
    k = F.col("o_orderkey")
    buildings = v.table("orders").select(k.alias("building_id"), F.when(k % 3 == 0, 1700).alias("est_start_year"))
    new = v.table("orders").where(k % 2 == 0).select(k.alias("building_id"), (1850 + k % 100).cast("int").alias("start_year"), F.lit(0.5).alias("confidence"), F.lit("range").alias("method"))
    return evidence.apply_estimates(buildings, new)


@query("SELECT concat(CASE WHEN p_size % 2 = 0 THEN 'ml-' ELSE '' END, CAST(p_partkey AS VARCHAR)) AS key, concat('data/', p_brand) AS path, CAST(CASE WHEN p_size % 3 > 0 THEN 1850 + p_size END AS INT) AS year, p_size AS priority FROM part")
def a17_export_manifest(v):
    size = F.col("p_size")
    src = F.concat(F.when(size % 2 == 0, "ml_").otherwise(""), "p_partkey")
    return sinks.export_manifest(v.table("part").select(src.alias("src"), F.concat(F.lit("/srv/x/data/"), "p_brand").alias("path"), F.when(size % 3 > 0, 1850 + size).cast("int").alias("reference_year"), size.alias("priority")))


@query("""SELECT p_brand AS src, stage, record_count FROM (SELECT p_brand, 'normalize' AS stage, count(*) AS record_count FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT p_brand, 'ingest', 7 FROM part
    UNION ALL SELECT p_brand, 'normalize', 1 FROM part GROUP BY 1 HAVING count(*) FILTER (p_size % 2 = 0) = 0)""")
def a18_update_manifest(v):
    """An older entry of each stage; the counts of the newer one replace those of its stage."""
    part, old = v.table("part"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("at")
    brands = part.select(F.col("p_brand").alias("src")).distinct()
    known = [brands.select("src", F.lit(stage).alias("stage"), F.lit(n).cast("long").alias("record_count"), old) for stage, n in (("ingest", 7), ("normalize", 1))]
    counts = part.where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("src")).agg(F.count("*").alias("n"))
    return sinks.update_manifest(known[0].union(known[1]), "normalize", counts, "2024-01-01 00:00:00").select("src", "stage", "record_count")


# ---------------------------------------------------------------- map elements and registers


def _elements(v: Views) -> tuple[DataFrame, DataFrame]:
    """A way of each order's corners, of which some are unknown nodes, and those nodes."""
    k, corner = F.col("o_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(4)))
    nodes = v.table("orders").select(k, corner.alias("c")).where((k % 6 != 5) | (F.col("c") < 3))
    nodes = nodes.select((k * 8 + F.col("c")).alias("id"), (k % 100 + F.col("c") % 2).cast("double").alias("lon"), F.floor(F.col("c") / 2).cast("double").alias("lat"))
    tags = F.create_map(F.lit("building"), F.lit("yes"), F.when(k % 2 == 0, "start_date").otherwise("construction_date"), F.when(k % 3 == 0, F.concat(F.lit("ca "), 1800 + k % 100)).otherwise("soon"))
    return v.table("orders").select(k.alias("id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: k * 8 + c).alias("nodes"), tags.alias("tags")), nodes


@query("SELECT o_orderkey AS id, CAST(6 AS BIGINT) AS points, CAST(o_orderkey % 100 AS DOUBLE) AS first_x, CAST(o_orderkey % 100 AS DOUBLE) AS last_x FROM orders WHERE o_orderkey % 6 <> 5")
def b5_assemble_polygons(v):
    """Polygons of ways; three known nodes are too few, and open ways are closed."""
    p = geo.points(F.col("geometry"))
    return normalize.assemble_ways(*_elements(v)).select("id", F.size(p).cast("long").alias("points"), p[0]["x"].alias("first_x"), F.element_at(p, -1)["x"].alias("last_x"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS gtype, CAST(1 + o_orderkey % 2 AS BIGINT) AS parts FROM orders WHERE o_orderkey % 6 <> 5 AND o_orderkey % 7 <> 3")
def b7_assemble_relations(v):
    """Relations of one or two outer ways and an inner one; a missing outer way leaves its relation out."""
    k, member = F.col("o_orderkey"), lambda ref, role: F.struct(F.lit("way").alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    one, inner = member(k, "outer"), member(F.lit(-1).cast("long"), "inner")
    members = F.when(k % 7 == 3, F.array(one, member(F.lit(-2).cast("long"), "outer"))).when(k % 2 == 0, F.array(one, inner)).otherwise(F.array(one, inner, one))
    found = normalize.assemble_relations(v.table("orders").select(k.alias("id"), members.alias("members")), normalize.assemble_ways(*_elements(v)))
    return found.select("id", "geometry.gtype", F.size("geometry.parts").cast("long").alias("parts"))


@query("SELECT concat('way/', CAST(o_orderkey AS VARCHAR)) AS src_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1800 + o_orderkey % 100 END AS INT) AS sd, CASE WHEN o_orderkey % 3 = 0 THEN 'h' ELSE 'l' END AS ev, 'yes' AS bt FROM orders WHERE o_orderkey % 6 <> 5")
def b8_normalize_osm(v):
    return normalize.normalize_osm(normalize.assemble_ways(*_elements(v))).select("src_id", "sd", "ev", "bt")


def _registry(v: Views) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    return v.table("orders").select(
        F.when(k % 8 > 0, F.concat(F.lit("S"), k)).alias("sefrak_id"), F.when(k % 9 > 0, (1750 + k % 150).cast("string")).alias("start_date"), F.when(k % 2 == 0, (1760 + k % 150).cast("string")).alias("end_date"),
        F.lit("Kirke").alias("original_function_name"), none.alias("current_function_name"), none.alias("bygningstype"), none.alias("name"), F.when(k % 3 == 0, "0").alias("sefrak_status"),
        F.when(k % 10 > 0, 569_000.0 + k % 1000).alias("easting"), (7_034_000.0 + k % 500).alias("northing"),
    )


@query("SELECT concat('S', CAST(o_orderkey AS VARCHAR)) AS src_id, CAST(1750 + o_orderkey % 150 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS INT) AS sd, 'religious' AS bt, o_orderkey % 3 = 0 AS demolished FROM orders WHERE o_orderkey % 8 > 0 AND o_orderkey % 9 > 0 AND o_orderkey % 10 > 0")
def b10_normalize_registry(v):
    return normalize.normalize_registry(_registry(v))[0].select("src_id", "sd", "bt", "demolished")


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'no_geometry' WHEN o_orderkey % 8 = 0 THEN 'no_id' ELSE 'no_date' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 GROUP BY 1")
def b10_registry_rejects(v):
    return normalize.normalize_registry(_registry(v))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS src_id, CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 'm' END AS ev, CASE WHEN p_size % 3 = 0 THEN 'religious' END AS bt, CASE WHEN p_size % 5 > 0 THEN 'by' ELSE '' END AS told FROM part")
def b15_normalize_manual(v):
    size = F.col("p_size")
    rows = v.table("part").select(F.concat(F.lit("m"), "p_partkey").alias("src_id"), F.lit("way/1").alias("osm_ref"), F.lit(1900).alias("sd"), F.lit(None).cast("int").alias("ed"), F.when(size % 2 == 0, "h").alias("ev"), F.when(size % 3 == 0, "religious").otherwise("hut").alias("use"), F.create_map(F.lit("by"), F.when(size % 5 > 0, "me"), F.lit("note"), F.lit(None).cast("string")).alias("provenance"), F.lit("g").alias("geometry"))
    return normalize.normalize_manual(rows).select("src_id", "ev", "bt", F.array_join(F.map_keys("provenance"), ",").alias("told"))


@query("SELECT concat('ml-', CAST(id AS VARCHAR)) AS src_id, CAST(CASE WHEN id % 2 = 0 THEN 1947 ELSE 1880 END AS INT) AS sd, 'historical' AS rt FROM roads WHERE id % 3 > 0 AND id % 5 > 0")
def b17_normalize_ml_roads(v):
    k = F.col("id")
    shape = F.struct(F.when(k % 5 == 0, "Polygon").otherwise("LineString").alias("gtype"), F.array(F.array(F.array(geo.point(F.col("x0"), F.col("y0")), geo.point(F.col("x1"), F.col("y1"))))).alias("parts"))
    rows = v("roads").select(F.when(k % 2 == 0, "ml_aerial").otherwise("ml_kartverket_1880").alias("src"), k.cast("string").alias("feature_id"), F.when(k % 3 > 0, 2).otherwise(1).alias("class_id"), F.lit(0.8).alias("confidence"), shape.alias("geometry"))
    return normalize.normalize_ml_roads(rows, v.spark.createDataFrame([("ml_aerial", 1947)], "src string, reference_year int")).select("src_id", "sd", "rt")


@query("""SELECT id, CAST(CASE WHEN gone THEN 1880 WHEN p THEN 1800 WHEN s = 3 THEN NULL ELSE 1850 + id % 100 END AS INT) AS sd, CAST(CASE WHEN p AND NOT gone THEN 1850 END AS INT) AS sd_max, CASE WHEN gone THEN 'n' WHEN p THEN 'x' WHEN s = 0 THEN 'x' WHEN s = 1 THEN 'n' WHEN s = 2 THEN 'x' ELSE 'u' END AS sd_t,
    CAST(CASE WHEN gone THEN 0.7 WHEN s = 1 AND NOT p THEN 0.5 END AS DOUBLE) AS sd_c, CAST(CASE WHEN gone THEN 2000 WHEN id % 2 = 0 THEN 1990 END AS INT) AS ed FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS s, o_orderkey % 9 = 0 AS gone, o_orderkey % 5 = 0 AS p FROM orders)""")
def b24_to_bound_schema(v):
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, ("osm", "ml_kartverket_1880", "finn", "other"))), (k % 4 + 1).cast("int"))
    rows = v.table("orders").select(k.alias("id"), source.alias("source"), F.when(k % 5 == 0, "1800-1850").alias("period"), F.when(k % 9 == 0, "demolished").alias("status"), F.lit(None).cast("int").alias("existed_in"), (1850 + k % 100).cast("string").alias("start_date"), F.when(k % 2 == 0, "1990").otherwise("2025").alias("end_date"), F.lit(None).cast("double").alias("confidence"))
    return normalize.to_bound_schema(rows).select("id", "sd", "sd_max", "sd_t", "sd_c", "ed")


#: The zone's projection, restated: terms of the series by the ellipsoid's third flattening n.
UTM = """WITH k AS (SELECT o_orderkey AS id, CAST(569000 + o_orderkey % 1000 AS DOUBLE) AS e, CAST(7034000 + o_orderkey % 500 AS DOUBLE) AS nn, (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n FROM orders),
    a AS (SELECT *, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS r FROM k), b AS (SELECT *, nn / (0.9996 * r) AS xi, (e - 500000) / (0.9996 * r) AS eta, n / 2 - 2 * n * n / 3 + 37 * pow(n, 3) / 96 AS b1, n * n / 48 + pow(n, 3) / 15 AS b2, 17 * pow(n, 3) / 480 AS b3 FROM a),
    c AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS u, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS w FROM b),
    d AS (SELECT *, asin(sin(u) / cosh(w)) AS chi FROM c)
    SELECT id, round(9 + degrees(atan2(sinh(w), cos(u))), 6) AS lon, round(degrees(chi + (2 * n - 2 * n * n / 3 - 2 * pow(n, 3)) * sin(2 * chi) + (7 * n * n / 3 - 8 * pow(n, 3) / 5) * sin(4 * chi) + 56 * pow(n, 3) / 15 * sin(6 * chi)), 6) AS lat FROM d"""


@query(UTM)
def i20_utm32_to_lonlat(v):
    k = F.col("o_orderkey")
    place = geo.utm32_to_lonlat((569_000 + k % 1000).cast("double"), (7_034_000 + k % 500).cast("double"))
    return v.table("orders").select(k.alias("id"), place.alias("p")).select("id", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


@query("SELECT p_partkey AS property_id, CASE WHEN p_size % 3 > 0 THEN p_name END AS address, CAST(CASE WHEN p_size % 4 > 0 THEN 1900 + p_size END AS INT) AS sd FROM part WHERE p_size % 7 > 0 UNION ALL SELECT NULL, p_name, CAST(CASE WHEN p_size % 4 > 0 THEN 1900 + p_size END AS INT) FROM part WHERE p_size % 7 = 0 AND p_size % 3 > 0")
def b30_normalize_property(v):
    size = F.col("p_size")
    rows = v.table("part").select(F.when(size % 7 > 0, F.col("p_partkey")).alias("property_id"), F.when(size % 3 > 0, F.col("p_name")).alias("address"), F.when(size % 4 > 0, F.concat(F.lit("3/14/"), 1900 + size, F.lit(" 0:00:00"))).otherwise("14.3.1950").alias("built"), F.lit(569_000.0).alias("easting"), F.lit(7_034_000.0).alias("northing"))
    return normalize.normalize_property(rows).select("property_id", "address", "sd")


# ---------------------------------------------------------------- filters, folds and scalars


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'old') OR contains(lower(p_name || ' ' || p_type), 'gammel') OR contains(lower(p_name || ' ' || p_type), '1900')")
def c15_filter_titles(v):
    return filters.filter_keywords(v.table("part"), ["p_name", "p_type"], ["gammel", "OLD", "1900"]).select("p_partkey", "p_name")


@query("SELECT ord, ev FROM base_features WHERE ev IN ('h', 'm')")
def c19_rule_evidence(v):
    return filters.filter_evidence(v("base_features"), text.rule_min_evidence("keep where evidence >= Medium")).select("ord", "ev")


@query("""WITH f AS (SELECT o_orderkey AS id, 1880 + l_linenumber % 4 * 20 AS y, l_returnflag = 'N' AS seen, l_discount AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT id, count(DISTINCT y) AS checked, count(DISTINCT CASE WHEN seen THEN y END) AS seen, CAST(min(CASE WHEN seen THEN y END) AS INT) AS verified_by, max(CASE WHEN seen THEN c END) AS best FROM f GROUP BY id""")
def f14_verification(v):
    rows = v.table("orders").join(v.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), (1880 + F.col("l_linenumber") % 4 * 20).cast("int").alias("map_year"), (F.col("l_returnflag") == "N").alias("found"), F.col("l_discount").alias("confidence"))
    return resolve.fold_detections(rows).select("id", "checked", "seen", "verified_by", "best")


@query("""SELECT id, 'old' AS side, CASE WHEN id % 6 = 1 THEN 'same' ELSE 'removed' END AS change FROM roads WHERE id % 2 = 1 UNION ALL SELECT id, 'new', 'new' FROM roads WHERE id % 2 = 0 AND (id % 6 <> 2)""")
def h7_split_matches(v):
    """Odd roads are old ones, of which every third is matched to the next, even road."""
    old, new, k = v("roads").where("id % 2 = 1"), v("roads").where("id % 2 = 0"), F.col("id")
    matches = old.where(k % 6 == 1).select("id", (k + 1).alias("other"), F.lit(0.9).alias("lss"), F.lit(2.0).alias("hausdorff"), F.lit(False).alias("width_change"), F.lit(True).alias("same_ends"))
    return roads.split_matches(old, new, matches)


@query("SELECT id, CAST(id AS VARCHAR) AS rid, concat(CASE src WHEN 'osm' THEN 'osm' ELSE 'sef' END, '-', CAST(id AS VARCHAR)) AS bid FROM (SELECT id, sd_src AS src FROM registry_points)")
def i8_codes(v):
    k, src = F.col("id"), F.col("sd_src")
    own = F.concat(F.when(src == "osm", "way/").otherwise("SEFRAK-"), k)
    return v("registry_points").select("id", text.road_code(F.concat(F.when(k % 2 == 0, "nvdb/12-").otherwise("way/"), k)).alias("rid"), text.feature_code(src, own).alias("bid"))


@query("""SELECT ord AS id, CASE WHEN sd < 1750 THEN 'Early 18th Century' WHEN sd < 1800 THEN 'Late 18th Century' WHEN sd < 1850 THEN 'Early 19th Century' WHEN sd < 1900 THEN 'Late 19th Century' WHEN sd < 1950 THEN 'Early 20th Century' WHEN sd < 2000 THEN 'Late 20th Century' WHEN sd >= 2000 THEN '21st Century' END AS era,
    CASE WHEN sd < 1800 THEN 'SEFRAK (Riksantikvaren)' WHEN sd < 1900 THEN 'SEFRAK (Riksantikvaren) + Kartverket Historical' WHEN sd < 1950 THEN 'Kartverket Historical' WHEN sd >= 1950 THEN 'OpenStreetMap' ELSE '' END AS told FROM base_features""")
def i10_era7(v):
    return v("base_features").select(F.col("ord").alias("id"), dates.era(F.col("sd"), 7).alias("era"), dates.data_sources(F.col("sd")).alias("told"))


@query("SELECT id, round(x / 1e5 + 20 / (111320.0 * cos(radians(63.4))), 9) AS east, round(y / 1e5 + 20 / 111320.0, 9) AS north FROM registry_points")
def i23_metres_to_degrees(v):
    dx, dy = geo.metres_to_degrees(20.0, 63.4)
    return v("registry_points").select("id", F.round(F.col("x") / 1e5 + dx, 9).alias("east"), F.round(F.col("y") / 1e5 + dy, 9).alias("north"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS first, CASE WHEN p_size % 2 = 0 THEN 'name,ref,x' ELSE 'ref,x' END AS there, CASE WHEN p_size % 2 = 0 THEN 'name,x' ELSE 'x' END AS chosen FROM part")
def i24_tags(v):
    tags = F.create_map(F.lit("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.lit("ref"), F.col("p_brand"), F.lit("x"), F.lit("1"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return v.table("part").select(F.col("p_partkey").alias("id"), text.first_tag(tags, ("name", "ref")).alias("first"), keys(text.without_nulls(tags)).alias("there"), keys(text.subset(tags, ("name", "x"))).alias("chosen"))


@query("""SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(least(x0 + (c + 1) * 50, x1) AS DOUBLE) AS right_x, CAST(least(y0 + (r + 1) * 50, y1) AS DOUBLE) AS top_y
    FROM detections, LATERAL (SELECT unnest(range(CAST(greatest(ceil((y1 - y0) / 50.0), 1) AS BIGINT))) AS r), LATERAL (SELECT unnest(range(CAST(greatest(ceil((x1 - x0) / 50.0), 1) AS BIGINT))) AS c)""")
def i25_metre_grid(v):
    grid = tiles.metre_grid(v("detections"), 50.0, "box", (1.0, 1.0))
    return grid.select("id", "row", "col", F.col("tile.x1").cast("double").alias("right_x"), F.col("tile.y1").cast("double").alias("top_y"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(sum(px) AS BIGINT) AS sum_x FROM (SELECT id, unnest(range(0, CAST(floor((x1 - x0) / 25.0) AS BIGINT) + 1)) * 25 + x0 AS px, CAST(floor((y1 - y0) / 25.0) AS BIGINT) + 1 AS ny FROM detections), LATERAL (SELECT unnest(range(ny))) GROUP BY id")
def i25_point_grid(v):
    return tiles.point_grid(v("detections"), 25.0, "box").groupBy("id").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("sum_x"))


@query("""SELECT id, CAST(px AS INT) AS px, CAST(py AS INT) AS py, CAST(least(64, w - px) AS INT) AS pw, CAST(least(64, h - py) AS INT) AS ph FROM (SELECT id, x1 - x0 + 100 AS w, y1 - y0 + 100 AS h FROM detections),
    LATERAL (SELECT unnest(range(0, w, 48)) AS px), LATERAL (SELECT unnest(range(0, h, 48)) AS py) WHERE (w - px) * 2 >= 64 AND (h - py) * 2 >= 64""")
def i25_raster_windows(v):
    rows = v("detections").select("id", (F.col("x1") - F.col("x0") + 100).cast("int").alias("width"), (F.col("y1") - F.col("y0") + 100).cast("int").alias("height"))
    return tiles.raster_windows(rows, 64, 16).select("id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("pw").cast("int").alias("pw"), F.col("ph").cast("int").alias("ph"))


# ---------------------------------------------------------------- streams


def _in_three(v: Views, rows: DataFrame, start) -> str:
    """Run start(stream, root) to its end three times under one checkpoint: with the edits of each third, and those of the first third again each time."""
    root = f"{shared(v.spark)}/stream-{uuid.uuid4().hex}"
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{root}/in")
        if k:
            rows.where("event_id % 3 = 0").write.mode("append").parquet(f"{root}/in")
        start(v.spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root).awaitTermination()
    return root


@query("SELECT fid, sd, note, event_id, 'h' AS ev FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY edited_at DESC, event_id DESC) AS n FROM edits) WHERE n = 1")
def k1_merge_edits(v):
    """The edit stream in three runs, late and repeated edits among them; its snapshot."""
    root = _in_three(v, v("edits"), lambda stream, root: edits.merge_edits(stream, f"{root}/out", f"{root}/state"))
    return edits.snapshot(v.spark, f"{root}/out").select("fid", "sd", "note", "event_id", "ev")


@query("SELECT event_id, fid, note FROM edits WHERE event_id % 11 > 0 UNION ALL SELECT event_id, fid, note FROM edits, (SELECT unnest(range(0, 3)) AS k) WHERE event_id % 11 = 0 AND (k = 0 OR event_id % 3 = 0)")
def k2_dedup_ingest(v):
    """Edits come again in later runs and are appended once, but for those without a code."""
    rows = v("edits").withColumn("code", F.when(F.col("event_id") % 11 > 0, F.col("event_id")))
    root = _in_three(v, rows, lambda stream, root: edits.dedup_ingest(stream, "code", "edited_at", f"{root}/out", f"{root}/state"))
    return edits.results(v.spark, f"{root}/out").select("event_id", "fid", "note")


@query("SELECT fid, fid % 3 = 0 AS matched, event_id FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY event_id % 3, event_id) AS n FROM edits) WHERE n = 1")
def k3_process_once(v):
    """Users are matched once, by their first edit in the run in which they first come."""
    work = lambda df: df.select("fid", (F.col("fid") % 3 == 0).alias("matched"), "event_id")
    root = _in_three(v, v("edits").select("fid", "event_id"), lambda stream, root: edits.process_once(stream, "fid", work, f"{root}/out", f"{root}/state", ("event_id",)))
    return edits.results(v.spark, f"{root}/out").select("fid", "matched", "event_id")


# ---------------------------------------------------------------- kernels


def _moved(v: Views, *only: str) -> DataFrame:
    """Each road as a line and the same line moved north by id % 14 and east by one."""
    line = lambda dx, dy: F.struct(F.lit("LineString").alias("gtype"), F.array(F.array(F.array(geo.point(F.col("x0") + dx, F.col("y0") + dy), geo.point(F.col("x1") + dx, F.col("y1") + dy)))).alias("parts"))
    return v("roads").select("id", lines.line_match((1.0, 1.0), only=only)(line(F.lit(0), F.lit(0)), line(F.lit(1), F.col("id") % 14)).alias("m"))


def _off(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """SQL for the distance of a point to a segment that is not a point."""
    t = f"least(1.0, greatest(0.0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / CAST(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}) AS DOUBLE)))"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


LINES = "l AS (SELECT id, x0 AS a1, y0 AS a2, x1 AS b1, y1 AS b2, x0 + 1 AS c1, y0 + id % 14 AS c2, x1 + 1 AS d1, y1 + id % 14 AS d2 FROM roads)"


@query(f"WITH {LINES} SELECT id, round(greatest({_off('a1', 'a2', 'c1', 'c2', 'd1', 'd2')}, {_off('b1', 'b2', 'c1', 'c2', 'd1', 'd2')}, {_off('c1', 'c2', 'a1', 'a2', 'b1', 'b2')}, {_off('d1', 'd2', 'a1', 'a2', 'b1', 'b2')}), 6) AS hausdorff FROM l")
def n2_hausdorff(v):
    return _moved(v, "hausdorff").select("id", F.round("m.hausdorff", 6).alias("hausdorff"))


@query(f"WITH {LINES} SELECT id, avg({_off('a1 + k * (b1 - a1) / 9.0', 'a2 + k * (b2 - a2) / 9.0', 'c1', 'c2', 'd1', 'd2')}) BETWEEN 2 AND 10 AS width_change FROM l, range(10) t(k) GROUP BY id")
def n5_width_changed(v):
    return _moved(v, "width_change").select("id", "m.width_change")


@query("SELECT id, CASE WHEN abs((x1 - x0) * (my - y0) - (mx - x0) * (y1 - y0)) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 5 THEN 3 ELSE 2 END AS points FROM (SELECT *, (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 + id % 11 AS my FROM roads)")
def n6_simplify(v):
    """A point between a road's ends stays if it lies more than five units from the line."""
    middle = geo.point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2 + F.col("id") % 11)
    line = F.struct(F.lit("LineString").alias("gtype"), F.array(F.array(F.array(geo.point(F.col("x0"), F.col("y0")), middle, geo.point(F.col("x1"), F.col("y1"))))).alias("parts"))
    return v("roads").select("id", F.size(geo.points(kernels.simplified(5.0)(line))).alias("points"))


@query("SELECT ord AS id, CASE ord % 4 WHEN 1 THEN 'open' WHEN 2 THEN 'too short' WHEN 3 THEN 'crossing' END AS fault FROM base_features")
def n7_geometry_fault(v):
    k, p = F.col("ord"), lambda x, y: geo.point(F.col(x), F.col(y))
    a, b, c, d = p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")
    ring = F.when(k % 4 == 1, F.array(a, b, c, d)).when(k % 4 == 2, F.array(a, b, a)).when(k % 4 == 3, F.array(a, c, b, d, a)).otherwise(F.array(a, b, c, d, a))
    shape = F.struct(F.lit("Polygon").alias("gtype"), F.array(F.array(ring)).alias("parts"))
    return v("base_features").select(k.alias("id"), kernels.geometry_fault(shape).alias("fault"))
