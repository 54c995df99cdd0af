"""Counts and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and dated rows of each group."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"), F.count("sd").alias("dated"))


def count_by_era(df: DataFrame, bins: int = 3, year: str = "sd") -> DataFrame:
    return df.groupBy(F.coalesce(dates.era(F.col(year), bins), F.lit("undated")).alias("era")).agg(F.count("*").alias("n"))


def count_by_decade(df: DataFrame, year: str = "sd") -> DataFrame:
    return df.where(F.col(year).isNotNull()).groupBy((F.floor(F.col(year) / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def share(n: Column, total: Column) -> Column:
    """Percent with one decimal."""
    return F.round(100.0 * n / total, 1)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value and their percentage."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over groups, not rows
    return counts.select(column, "n", share(F.col("n"), total).alias("pct"))


def quality_report(df: DataFrame, this_year: int, area_m2: Column | None = None) -> DataFrame:
    """One row: rows, dated rows, date anomalies, tiny and huge areas, evidence levels, single and multi source, replaced rows by era, mean lifespan."""
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    sd, ed, era = F.col("sd"), F.col("ed"), dates.era(F.col("sd"))
    replaced = F.col("repl_by").isNotNull() if "repl_by" in df.columns else F.lit(False)
    several = F.size("src_all") > 1 if "src_all" in df.columns else F.lit(False)
    columns = [
        F.count("*").alias("total"),
        F.count("sd").alias("dated"),
        one(ed < sd).alias("end_before_start"),
        one(sd > this_year).alias("future_start"),
        one(sd < 1600).alias("very_old"),
        *[one(F.col("ev") == e).alias(f"ev_{e}") for e in "hml"],
        one(several).alias("multi_source"),
        one(~several).alias("single_source"),
        *[one(replaced & (era == e)).alias(f"replaced_{e}") for e in ("pre_1900", "1900_1950", "post_1950")],
        F.round(F.avg(F.when(ed >= sd, ed - sd)), 1).alias("mean_lifespan"),
    ]
    if area_m2 is not None:
        columns += [one(area_m2 < 5).alias("tiny"), one(area_m2 > 50_000).alias("huge")]
    return df.agg(*columns)


def road_quality_report(df: DataFrame, length: str = "len") -> DataFrame:
    """Per road type: roads, dated ones, kilometres, evidence levels."""
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return df.groupBy("rt").agg(F.count("*").alias("n"), F.count("sd").alias("dated"), F.round(F.sum(length) / 1000, 2).alias("km"), *[one(F.col("ev") == e).alias(f"ev_{e}") for e in "hml"])


def estimates_by_method(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.min("start_year").alias("min_year"), F.max("start_year").alias("max_year"))


def confidence_histogram(df: DataFrame, bins: int = 5) -> DataFrame:
    """Rows of each of `bins` equal steps of confidence 0..1, and their percentage."""
    part = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return distribution(df.where("confidence IS NOT NULL").select(part.alias("bin")), "bin")


def confusion_matrix(df: DataFrame, truth: str, pred: str, ignore: int | None = None) -> DataFrame:
    """Rows of each pair of classes."""
    rows = df if ignore is None else df.where(F.col(truth) != ignore)
    return rows.groupBy(truth, pred).agg(F.count("*").alias("n"))


def iou_per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class: intersection, union, intersection over union; null for a class without rows."""
    sides = df.select(F.explode(F.array_distinct(F.array(truth, pred))).alias("cls"), ((F.col(truth) == F.col(pred))).cast("int").alias("hit"))
    return sides.groupBy("cls").agg(F.sum("hit").alias("shared"), F.count("*").alias("union")).withColumn("iou", F.round(F.col("shared") / F.col("union"), 9))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """Inverse frequencies scaled to mean 1."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # over classes, which are few
    raw = counts.withColumn("raw", F.sum("n").over(every) / F.col("n"))
    return raw.select(column, "n", F.round(F.col("raw") / F.avg("raw").over(every), 9).alias("weight"))


def annotation_progress(done: DataFrame, total: int, by: str = "mapper") -> DataFrame:
    """Per annotator: tiles done, mean gap in seconds between them, tiles left of the total."""
    at = F.col("at").cast("timestamp").cast("long")
    gap = at - F.lag(at).over(Window.partitionBy(by).orderBy("at", "tile"))
    return done.withColumn("gap", gap).groupBy(by).agg(F.count("*").alias("done"), F.round(F.avg("gap"), 3).alias("mean_gap_s")).withColumn("left", F.lit(total) - F.col("done"))


def gcp_rms(df: DataFrame) -> DataFrame:
    """Root mean square of residuals (map_id, dx, dy) in metres, and its class."""
    rms = df.groupBy("map_id").agg(F.round(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), 6).alias("rms"), F.count("*").alias("points"))
    return rms.withColumn("quality", F.when(F.col("rms") < 5, "excellent").when(F.col("rms") < 15, "good").when(F.col("rms") < 30, "fair").otherwise("poor"))


def gcp_bounds(gcps: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bounds of each map (map_id, width, height) from the spread of its control points."""
    g = gcps.groupBy("map_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("pixel_x", "pixel_y", "geo_x", "geo_y") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    sx = (F.col("max_geo_x") - F.col("min_geo_x")) / (F.col("max_pixel_x") - F.col("min_pixel_x"))
    sy = (F.col("max_geo_y") - F.col("min_geo_y")) / (F.col("max_pixel_y") - F.col("min_pixel_y"))
    west, north = F.col("avg_geo_x") - F.col("avg_pixel_x") * sx, F.col("avg_geo_y") + F.col("avg_pixel_y") * sy
    return g.join(sizes, "map_id").select("map_id", west.alias("x0"), (north - F.col("height") * sy).alias("y0"), (west + F.col("width") * sx).alias("x1"), north.alias("y1"))


def source_counts(df: DataFrame, year: int) -> DataFrame:
    """Visible rows of each source in a year."""
    from . import filters

    return filters.buildings_as_of(df, year).groupBy("src").agg(F.count("*").alias("n"))


def inspect_stats(df: DataFrame, source: str) -> DataFrame:
    """Rows and mean confidence of one detected source."""
    return df.where(F.col("src") == source).groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def stats_by_group(df: DataFrame, column: str) -> DataFrame:
    """Per group: rows, first and last year."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min("sd").alias("first_year"), F.max("sd").alias("last_year"))


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def export_stats(df: DataFrame) -> DataFrame:
    """(part, name, n, pct) of exported features (src, sd, ed, ev, ml_src, src_all, rep_by): sources, evidence, maps, dates, several sources, replaced ones, first and last year.

    n of `first` and `last` is a year. Everything comes from one aggregation by (src, ev, ml_src).
    """
    several = F.coalesce(F.size("src_all") > 1, F.lit(False)) if "src_all" in df.columns else F.lit(False)
    replaced = F.col("rep_by").isNotNull() if "rep_by" in df.columns else F.lit(False)
    one = lambda test: F.sum(test.cast("long"))
    groups = df.groupBy(F.coalesce("src", F.lit("unknown")).alias("src"), F.coalesce("ev", F.lit("unknown")).alias("ev"), "ml_src").agg(
        F.count("*").alias("n"), F.count("sd").alias("start"), F.count("ed").alias("end"), one(several).alias("several"), one(replaced).alias("replaced"), F.min("sd").alias("low"), F.max("sd").alias("high")
    )
    entry = lambda part, name, n: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    total = lambda name: entry("all", F.lit(name), F.col(name))
    entries = [entry("source", F.col("src"), F.col("n")), entry("evidence", F.col("ev"), F.col("n")), entry("map", F.col("ml_src"), F.col("n")), entry("all", F.lit("n"), F.col("n")), *map(total, ("start", "end", "several", "replaced"))]
    long = groups.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("name IS NOT NULL").groupBy("part", "name").agg(F.sum("n").alias("n"))
    whole = F.max(F.when((F.col("part") == "all") & (F.col("name") == "n"), F.col("n"))).over(Window.partitionBy(F.lit(1)))  # over a few counts
    years = groups.agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.explode(F.array(entry("years", F.lit("first"), F.col("low")), entry("years", F.lit("last"), F.col("high")))).alias("e")).select("e.*")
    return long.withColumn("pct", share(F.col("n"), whole)).union(years.withColumn("pct", F.lit(None).cast("double")))


def road_export_stats(df: DataFrame) -> DataFrame:
    """Exported roads and dated ones of each source; a source that is missing is `unk`."""
    return df.groupBy(F.coalesce("src", F.lit("unk")).alias("src")).agg(F.count("*").alias("n"), F.count("sd").alias("dated"))


def change_counts(df: DataFrame) -> DataFrame:
    """Roads of each kind of change."""
    return df.groupBy("change").agg(F.count("*").alias("n"))


def inference_stats(df: DataFrame, column: str = "sd_how") -> DataFrame:
    """(how, n, pct): how roads got their year, with percent of all; no year counts as `none`."""
    return distribution(df.withColumn("how", F.coalesce(F.col(column), F.lit("none"))), "how")


def merge_report(inputs: DataFrame, merged: DataFrame) -> DataFrame:
    """(part, name, n): input rows, output rows and dated output rows of each source."""
    part = lambda name, df, n: df.groupBy(F.lit(name).alias("part"), F.col("src").alias("name")).agg(n.alias("n"))
    return part("inputs", inputs, F.count("*")).union(part("output", merged, F.count("*"))).union(part("dated", merged, F.count("sd")))


def store_stats(ev: DataFrame) -> DataFrame:
    """Per kind of evidence: rows, buildings, rows with an end."""
    return ev.groupBy("evidence_type").agg(F.count("*").alias("n"), F.countDistinct("building_id").alias("buildings"), F.count("end_year").alias("with_end"))


def presence_stats(df: DataFrame, found: str = "found", sure: str = "sure", least: float = 0.7) -> DataFrame:
    """Rows of five buckets: existed or absent, each sure or not, and no coverage where the confidence is missing."""
    bucket = F.when(F.col(sure).isNull(), "no coverage").otherwise(F.concat(F.when(F.col(found), "existed").otherwise("absent"), F.when(F.col(sure) >= least, ", sure").otherwise(", unsure")))
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def status(sources: DataFrame, rows: DataFrame, done) -> DataFrame:
    """Per source (source): its rows and those that are done; sources without rows have none."""
    return sources.select("source").join(rows, "source", "left").groupBy("source").agg(F.count(F.col("id")).alias("raw"), F.count(F.when(done, 1)).alias("normalized"))
