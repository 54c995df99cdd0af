"""Registered queries of source normalisers, export schemas, sinks and image geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..lineage import shared
from ..sources import normalize, sinks
from .registry import ESTIMATE, _estimates, query


def _pick(k, *values):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN rt = 'primary' THEN ['geometry'] ELSE [] END || CASE WHEN rt = 'footway' THEN ['rt'] ELSE [] END || CASE WHEN sd > ed - 100 THEN ['order'] ELSE [] END) AS reason FROM roads) GROUP BY reason""")
def b4_road_rejects(v):
    rows = v("roads").withColumn("ed", F.col("ed") - 100).withColumn("geometry", F.struct(F.when(F.col("rt") == "primary", "Point").otherwise("LineString").alias("gtype")))
    return normalize.reject_counts(normalize.validate(rows, "mark", **normalize.road_rules()))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN ord % 7 = 0 THEN ['src_id'] ELSE [] END || CASE WHEN ord % 5 = 1 THEN ['ev'] ELSE [] END) AS reason FROM base_features) GROUP BY reason")
def b3_building_rejects(v):
    k = F.col("ord")
    rows = v("base_features").select(F.when(k % 7 > 0, F.col("fid")).alias("src_id"), F.col("box").alias("geometry"), F.when(k % 5 == 1, "x").otherwise(F.col("ev")).alias("ev"))
    return normalize.reject_counts(normalize.validate(rows, "mark", **normalize.building_rules()))


@query("SELECT p_partkey AS id, CAST(CASE WHEN c = 166 THEN 1660 WHEN c BETWEEN 170 AND 190 THEN c * 10 WHEN c = 191 THEN 1920 END AS INT) AS s, CAST(CASE WHEN c = 166 THEN 1700 WHEN c BETWEEN 170 AND 189 THEN c * 10 + 10 WHEN c = 190 THEN 1920 WHEN c = 191 THEN 1945 END AS INT) AS e FROM (SELECT p_partkey, 166 + p_size % 27 AS c FROM part)")
def b12_decode_time_code(v):
    code = F.concat(F.lit(" "), (166 + F.col("p_size") % 27).cast("string"))
    return v.table("part").select(F.col("p_partkey").alias("id"), normalize.decode_time_code(code).alias("t")).select("id", F.col("t.start").alias("s"), F.col("t.end").alias("e"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('l', CAST(o_orderkey AS VARCHAR)) ELSE CAST(o_orderkey AS VARCHAR) END AS src_id, CASE o_orderkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'industrial' WHEN 2 THEN 'commercial' WHEN 3 THEN 'public' WHEN 4 THEN 'religious' END AS bt FROM orders")
def b13_normalize_cadastre(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(F.when(k % 3 > 0, k.cast("string")).alias("bygningsnummer"), F.concat(F.lit("l"), k).alias("lokalId"), _pick(k, "111", " 212", "321", "613 ", "671", "999").alias("bygningstype"), F.lit("g").alias("geometry"))
    return normalize.normalize_cadastre(rows).select("src_id", "bt")


@query("SELECT concat('finn-', CAST(c_custkey AS VARCHAR)) AS src_id, CAST(1900 + c_custkey % 100 AS INT) AS sd, c_name AS nm FROM customer")
def b14_normalize_listings(v):
    k = F.col("c_custkey")
    rows = v.table("customer").select(k.alias("finn_code"), F.lit("way/1").alias("osm_ref"), (1900 + k % 100).cast("string").alias("year_built"), F.concat("c_name", F.lit(" , 7010 Town")).alias("address"), F.lit("g").alias("geometry"))
    return normalize.normalize_listings(rows).select("src_id", "sd", "nm")


@query("""SELECT concat('nvdb_', CAST(p_partkey AS VARCHAR), '_', CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS VARCHAR)) AS src_id, CASE WHEN p_size % 5 = 0 THEN 'path' ELSE CASE p_size % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'secondary' ELSE 'unknown' END END AS rt, CASE p_size % 3 WHEN 0 THEN concat('E', CAST(p_size AS VARCHAR)) WHEN 1 THEN concat('Fv', CAST(p_size AS VARCHAR)) END AS nm,
    CAST(CASE WHEN p_size % 7 = 0 THEN 1900 + p_size WHEN 1980 + p_size < 2000 THEN 1980 + p_size END AS INT) AS sd FROM part""")
def b18_normalize_nvdb(v):
    size = F.col("p_size")
    rows = v.table("part").select(
        F.col("p_partkey").alias("nvdb_id"), F.when(size % 4 > 0, size).alias("segment_id"), F.when(size % 5 == 0, "gangveg").alias("typeVeg"), _pick(size, "E", "F", "X").alias("vegkategori"), size.alias("vegnummer"), F.when(size % 7 == 0, (1900 + size).cast("string")).alias("construction_year"),
        F.concat(1980 + size, F.lit("-01-01")).alias("startdato"), F.lit(12.34).alias("lengde"), F.struct(F.lit("LineString").alias("gtype")).alias("geometry"),
    )
    return normalize.normalize_nvdb(rows).select("src_id", "rt", "nm", "sd")


@query("SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'harbor' WHEN 1 THEN 'lake' WHEN 2 THEN 'river' WHEN 3 THEN 'river' WHEN 4 THEN 'canal' WHEN 5 THEN 'lake' ELSE 'fjord' END AS w, CASE p_size % 7 WHEN 0 THEN 'road' WHEN 1 THEN 'water' WHEN 2 THEN 'water' WHEN 3 THEN 'road' WHEN 4 THEN 'road' WHEN 5 THEN 'road' ELSE 'railway' END AS c FROM part")
def b21_water_type_b22_class(v):
    tag = lambda *kv: F.create_map(*map(F.lit, kv))
    tags = F.element_at(F.array(tag("harbour", "yes"), tag("natural", "water", "water", "reservoir"), tag("natural", "water", "water", "river"), tag("waterway", "brook"), tag("waterway", "canal"), tag("landuse", "reservoir"), tag("rail", "tram")), (F.col("p_size") % 7 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), normalize.water_type(tags).alias("w"), normalize.infer_class(tags, F.lit("LineString")).alias("c"))


@query("SELECT concat(CASE WHEN src = 'osm' THEN 'osm' ELSE 'mat' END, '-', CAST(ord AS VARCHAR)) AS bid, CASE WHEN ord % 2 = 0 THEN 'osm,sef' END AS sources, sd, ed, ev FROM base_features")
def b26_export_buildings(v):
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    several = F.when(F.col("ord") % 2 == 0, F.array(F.lit("osm"), F.lit("sefrak"))).otherwise(F.array("src"))
    rows = v("base_features").select("src", F.col("fid").alias("src_id"), several.alias("src_all"), "sd", "ed", "ev", none("mlc", "double"), none("bt", "string"), none("nm", "string"), none("repl_by", "long"), F.col("box").alias("geometry"))
    return normalize.export_buildings(rows).select("bid", F.array_join("src_all", ",").alias("sources"), "sd", "ed", "ev")


@query("SELECT CAST(id AS VARCHAR) AS rid, CASE WHEN src = 'ml' THEN 'ml' ELSE 'nvdb' END AS src, rt, sd, round((x1 - x0) / 1000.0, 3) AS km FROM roads WHERE src <> 'ml' OR id % 10 >= 5")
def b27_export_roads(v):
    rows = v("roads").select(F.when(F.col("src") == "ml", "ml_kartverket_1880").otherwise("nvdb").alias("src"), F.concat(F.lit("way/"), "id").alias("src_id"), "rt", "nm", "sd", "ed", "ev", (F.col("x1") - F.col("x0")).alias("len"), (F.col("id") % 10 / 10).alias("mlc"), F.lit(None).cast("string").alias("change"), F.col("box").alias("geometry"))
    return normalize.export_roads(rows).select("rid", F.when(F.col("src") == "ml", "ml").otherwise("nvdb").alias("src"), "rt", "sd", "km")


@query(ESTIMATE.replace("SELECT d.building_id,", ", est AS (SELECT d.building_id,", 1) + ") SELECT building_id AS id, 'osm' AS src, start_year AS sd, CASE WHEN confidence >= 0.5 THEN 'h' ELSE 'm' END AS ev FROM est WHERE start_year IS NOT NULL AND confidence >= 0.3")
def b28_export_estimates(v):
    rows = _estimates(v).withColumn("building_id", F.concat(F.lit("osm-"), "building_id"))
    return normalize.export_estimates(rows).select(F.substring_index("building_id", "-", -1).cast("long").alias("id"), "src", "sd", "ev")


@query("SELECT p_partkey AS id, 'post' AS era, p_brand AS series, CAST(1900 + p_size AS INT) AS year, concat('t', CAST(p_partkey AS VARCHAR)) AS tile FROM part")
def b31_parse_tile_name(v):
    name = F.concat(F.lit("post_"), "p_brand", F.lit("_"), 1900 + F.col("p_size"), F.lit("_t"), "p_partkey", F.lit(".png"))
    return v.table("part").select(F.col("p_partkey").alias("id"), normalize.parse_tile_name(name).alias("t")).select("id", "t.era", "t.series", "t.year", "t.tile")


@query("SELECT ord AS id, round(x0 + ord % 256 / 256.0 * (x1 - x0), 6) AS gx, round(y1 - ord % 100 / 256.0 * (y1 - y0), 6) AS gy FROM base_features")
def i21_pixel_to_geo(v):
    k, size = F.col("ord"), F.lit(256)
    by_bounds = geo.pixel_to_geo(k % 256, k % 100, size, size, F.col("box"))
    rows = v("base_features").select("ord", by_bounds.alias("p"), geo.bounds_to_affine(F.col("box"), size, size).alias("t"))
    world = geo.affine(k % 256, k % 100, *(F.col(f"t.{c}") for c in "abcdef"))
    same = F.abs(world["x"] - F.col("p.x")) < 1e-6
    return rows.select(F.col("ord").alias("id"), F.when(same, F.round("p.x", 6)).alias("gx"), F.round("p.y", 6).alias("gy"))


@query("SELECT src, count(*) AS n, CAST(sum(ord) AS BIGINT) AS total FROM base_features GROUP BY src")
def a11_write_features(v):
    """The feature table as the sink writes it, by source, read again."""
    path = f"{shared(v.spark)}/features-{uuid.uuid4().hex}"
    sinks.write_features(v("base_features").select("ord", "src", "sd"), path)
    return v.spark.read.parquet(path).groupBy("src").agg(F.count("*").alias("n"), F.sum("ord").alias("total"))


@query("SELECT regexp_replace(p_brand, '[^A-Za-z0-9.-]', '_', 'g') AS grp, count(*) AS n FROM part GROUP BY 1")
def a12_write_by_group(v):
    path = f"{shared(v.spark)}/groups-{uuid.uuid4().hex}"
    sinks.write_by_group(v.table("part").select("p_brand", "p_partkey"), "p_brand", path)
    return v.spark.read.parquet(path).groupBy(F.col("group").cast("string").alias("grp")).agg(F.count("*").alias("n"))
