"""Reading feature sources: GeoJSON, element lists, registry XML, API pages, directories of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..lineage import cut

_POINTS = "array<array<double>>"


def geometry_from_json(kind, text):
    """A geometry of a GeoJSON type and its coordinates as JSON text; null for other types."""
    pts = lambda a: F.transform(a, lambda p: geo.point(p[0], p[1]))
    one, line = F.from_json(text, "array<double>"), F.from_json(text, _POINTS)
    rings, many = F.from_json(text, f"array<{_POINTS}>"), F.from_json(text, f"array<array<{_POINTS}>>")
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(geo.point(one[0], one[1])))))
        .when(kind == "LineString", F.array(F.array(pts(line))))
        .when(kind == "MultiLineString", F.transform(rings, lambda r: F.array(pts(r))))
        .when(kind == "Polygon", F.array(F.transform(rings, pts)))
        .when(kind == "MultiPolygon", F.transform(many, lambda p: F.transform(p, pts)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("gtype"), parts.alias("parts")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, properties map, geometry) of the features of FeatureCollection or Feature files; features without a geometry are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source_file"))
    whole = F.from_json("value", "type string, features array<string>, geometry string, properties string")
    rows = text.withColumn("w", whole)
    each = F.when(F.col("w.type") == "FeatureCollection", F.coalesce("w.features", F.array().cast("array<string>"))).when(F.col("w.type") == "Feature", F.array("value"))
    rows = rows.select("source_file", F.explode(each).alias("feature"))
    shape = F.from_json(F.get_json_object("feature", "$.geometry"), "type string, coordinates string")
    rows = rows.withColumn("g", shape).select("source_file", F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>").alias("properties"), geometry_from_json(F.col("g.type"), F.col("g.coordinates")).alias("geometry"))
    return rows.where("geometry IS NOT NULL")


def read_large_geojson(spark: SparkSession, path: str, begins: str = '{"type":"Feature",') -> DataFrame:
    """As read_geojson, of large FeatureCollections whose features all begin alike, as one writer writes them.

    Spark splits a file at that text, so that a single one is read by many tasks, a feature a row;
    what follows a feature is left unread. The text must not stand inside a feature.
    """
    rows = spark.read.option("lineSep", begins).text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    # what stands before a file's first feature is no feature: it has no geometry of its own
    rows = rows.select("source_file", F.concat(F.lit(begins), "value").alias("feature")).where(~F.col("value").rlike(r'"features"\s*:\s*\[\s*$'))
    whole = F.from_json("feature", "properties string, geometry struct<type:string,coordinates:string>")
    found = rows.select("source_file", whole.alias("w"))
    return found.select("source_file", F.from_json("w.properties", "map<string,string>").alias("properties"), geometry_from_json(F.col("w.geometry.type"), F.col("w.geometry.coordinates")).alias("geometry")).where("geometry IS NOT NULL")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson, of files with a feature a line, which split over tasks."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    shape = F.from_json(F.get_json_object("value", "$.geometry"), "type string, coordinates string")
    rows = rows.withColumn("g", shape).select(F.from_json(F.get_json_object("value", "$.properties"), "map<string,string>").alias("properties"), geometry_from_json(F.col("g.type"), F.col("g.coordinates")).alias("geometry"))
    return rows.where("geometry IS NOT NULL")


ELEMENT = "struct<type:string,id:long,lon:double,lat:double,nodes:array<long>,tags:map<string,string>,members:array<struct<type:string,ref:long,role:string>>>"


def read_osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of files with an `elements` list."""
    rows = spark.read.schema(f"elements array<{ELEMENT}>").json(path, multiLine=True)
    e = rows.select(F.inline("elements"))
    return e.where("type = 'node'").select("id", "lon", "lat", "tags"), e.where("type = 'way'").select("id", "nodes", "tags"), e.where("type = 'relation'").select("id", "members", "tags")


def read_registry_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of a tag of XML files, which split over tasks."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_nvdb(spark: SparkSession, path: str) -> DataFrame:
    """Road objects of API pages: ids, category, dates, length and geometry."""
    one = "id:long,egenskaper:array<struct<navn:string,verdi:string>>,lokasjon:struct<lengde:double>,metadata:struct<startdato:string,sluttdato:string>,geometri:struct<wkt:string>"
    rows = spark.read.schema(f"objekter array<struct<{one}>>").json(path, multiLine=True).select(F.inline("objekter"))
    named = F.map_from_entries(F.transform("egenskaper", lambda e: F.struct(e["navn"], e["verdi"])))
    return rows.select(F.col("id").alias("nvdb_id"), named.alias("properties"), F.col("lokasjon.lengde").alias("length"), F.col("metadata.startdato").alias("start"), F.col("metadata.sluttdato").alias("end"), geo.from_wkt(F.col("geometri.wkt")).alias("geometry"))


def read_pages(spark: SparkSession, path: str, schema: str, size: int | None = None, cap: int | None = None) -> DataFrame:
    """The rows of paged JSON result files (a folder or a pattern) together; with a page size, as far as each series goes.

    Files are called by series and page number, as `buildings-12.json`. A series goes on while its
    pages are full and follow each other: it ends with its first page of fewer rows, before a
    missing one, and after the page with which it has more than `cap` rows. Each file is read once.
    """
    rows = spark.read.schema(schema).json(path, multiLine=True)
    if size is None:
        return rows
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)-?(\d+)\.[^./]*$", 1)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.[^./]*$", 1).cast("long")
    named = cut(rows.withColumns({"_series": name, "_page": number}))
    sizes = named.groupBy("_series", "_page").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_series").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("_series").orderBy("_page")
    full = F.coalesce(F.min("n").over(before) >= size, F.lit(True))
    steady = F.col("_page") - F.row_number().over(order) == F.min("_page").over(Window.partitionBy("_series")) - 1
    within = F.coalesce(F.sum("n").over(before) <= cap, F.lit(True)) if cap is not None else F.lit(True)
    kept = sizes.select("_series", "_page", (full & steady & within).alias("goes_on")).where("goes_on").drop("goes_on")
    return named.join(kept, ["_series", "_page"], "left_semi").drop("_series", "_page")


def read_dir_with_source(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON files of a folder; the source is the file's name without its ending."""
    return read_geojson(spark, path).withColumn("src", F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1))


def discover_sources(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, path, record_count, ingested_at) of the manifest.json files below a folder. A few tasks a core list the folders, not a task each."""
    name, few = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), few))
    try:  # folders are listed here, when the table is made
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").schema("source_id string, record_count long, ingested_at string").json(root, multiLine=True)
    finally:
        spark.conf.set(name, before)
    return rows.select("*", F.regexp_replace(F.col("_metadata.file_path"), "/manifest.json$", "").alias("path")).where("source_id IS NOT NULL AND source_id <> ''")


def load_enabled(catalog: DataFrame, read) -> DataFrame:
    """The features of all enabled catalogue rows (src, path, priority, enabled), each tagged with its source and priority, in one table.

    The catalogue is a small configuration; read(path) gives a source's table.
    """
    rows = catalog.where("enabled").orderBy("priority", "src").limit(10_000).collect()
    out = None
    for r in rows:
        one = read(r.path).withColumn("src", F.lit(r.src)).withColumn("priority", F.lit(r.priority))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is enabled")
    return out
