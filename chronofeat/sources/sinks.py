"""Writing features, reports and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import latest_per_key


def geometry_to_json(geometry):
    """GeoJSON text of a geometry column."""
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    line = lambda pts: listed(F.transform(pts, pair))
    kind, parts = geometry["gtype"], geometry["parts"]
    coordinates = (
        F.when(kind == "Point", pair(parts[0][0][0]))
        .when(kind == "LineString", line(parts[0][0]))
        .when(kind == "MultiLineString", listed(F.transform(parts, lambda p: line(p[0]))))
        .when(kind == "Polygon", listed(F.transform(parts[0], line)))
        .when(kind == "MultiPolygon", listed(F.transform(parts, lambda p: listed(F.transform(p, line)))))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))


def feature_text(df: DataFrame, geometry: str = "geometry"):
    """The column of a row's GeoJSON feature; nulls and columns that begin with `_` are left out."""
    names = [c for c in df.columns if c != geometry and not c.startswith("_")]
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*names)), F.lit(',"geometry":'), F.coalesce(geometry_to_json(F.col(geometry)), F.lit("null")), F.lit("}"))


def to_geojson_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature a row, as column `value`."""
    return df.select(feature_text(df, geometry).alias("value"))


def write_features(df: DataFrame, path: str, fmt: str = "parquet", by: str = "src") -> None:
    """Parquet partitioned by source, or GeoJSON lines."""
    if fmt == "parquet":
        df.write.partitionBy(by).parquet(path)
    else:
        to_geojson_lines(df).write.text(path)


def safe_name(column):
    """A value as a file name: letters, digits, dot and dash, others `_`."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("none")), "[^A-Za-z0-9.-]", "_")


def write_by_group(df: DataFrame, column: str, path: str) -> None:
    """A folder for each value of a column."""
    df.withColumn("group", safe_name(F.col(column))).write.partitionBy("group").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """The rows of a report, few by nature, in one JSON file."""
    df.coalesce(1).write.json(path)


def export_manifest(catalog: DataFrame) -> DataFrame:
    """(key, path, year, priority) of sources for clients, in order of year."""
    key = F.regexp_replace(F.col("src"), "^ml_", "ml-")
    path = F.regexp_replace("path", "^.*/data/", "data/")
    return catalog.select(key.alias("key"), path.alias("path"), F.col("reference_year").alias("year"), "priority").orderBy(F.col("year").asc_nulls_last(), "key")


def update_manifest(manifest: DataFrame, stage: str, counts: DataFrame, at: str) -> DataFrame:
    """The manifest with a stage's counts (src, n) and time, the last entry of each source and stage."""
    new = counts.select("src", F.lit(stage).alias("stage"), F.col("n").alias("record_count"), F.lit(at).cast("timestamp").alias("at"))
    return latest_per_key(manifest.select("src", "stage", "record_count", "at").unionByName(new), ["src", "stage"], "at", "record_count")


def write_documents(rows: DataFrame, root: str, ending: str) -> None:
    """Rows (name, value) as files called name and ending below a new folder that all nodes share; names are unique and may have folders.

    Tasks write the files under their names, so that the driver touches none of them. The folder's
    file system must be one that Arrow knows: local or mounted, HDFS, S3 or GCS.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    whole = re.sub("^file:/+", "/", whole)
    fs.FileSystem.from_uri(whole)[0].create_dir(fs.FileSystem.from_uri(whole)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, top = fs.FileSystem.from_uri(whole)
        made = {top}
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                to = f"{top}/{name}{ending}"
                folder = to.rpartition("/")[0]
                if folder not in made:
                    there.create_dir(folder)
                    made = {top, folder}
                with there.open_output_stream(to) as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select("name", "value").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
