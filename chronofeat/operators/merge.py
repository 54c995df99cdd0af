"""Merges of matched records into one: who absorbs whom, whose geometry and attributes stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import link


def greedy_merge(df: DataFrame, links: DataFrame, this: str = "osm") -> DataFrame:
    """Rows (id, priority, src, gtype, sd, ed, ev) merged along links (a, b), unordered pairs of ids.

    In the order of priority and id every row that none has absorbed takes its own matches that are
    still free: a star, not a component. A merged row (seed) has the geometry of pick_geometry, the
    year of its first dated member in that order, the strongest evidence and all sources.
    """
    order = df.select("id", "priority")
    side = lambda x: order.select(F.col("id").alias(x), F.struct("priority", "id").alias(f"rank_{x}"))
    ends = links.where("a <> b").join(side("a"), "a").join(side("b"), "b")
    first = F.col("rank_a") < F.col("rank_b")
    pairs = ends.select(F.when(first, F.col("rank_a")).otherwise(F.col("rank_b")).alias("a"), F.when(first, F.col("rank_b")).otherwise(F.col("rank_a")).alias("b")).distinct()
    groups = link.duplicate_groups(df.select(F.struct("priority", "id").alias("id")), pairs)
    return merge_stars(df, groups.select(F.col("id.id").alias("id"), F.col("seed.id").alias("seed")), this)


def merge_stars(df: DataFrame, groups: DataFrame, this: str = "osm") -> DataFrame:
    """Rows of greedy_merge folded by groups (id, seed) that are known, as from link.duplicate_stars."""
    rows = df.join(groups, "id")
    place = F.struct("priority", "id")
    merged = rows.groupBy("seed").agg(
        F.min_by("sd", F.when(F.col("sd").isNotNull(), place)).alias("sd"),
        F.min_by("ed", F.when(F.col("ed").isNotNull(), place)).alias("ed"),
        text.evidence_of_rank(F.max(text.evidence_rank(F.col("ev")))).alias("ev"),
        F.array_sort(F.collect_set("src")).alias("src_all"),
        F.count("*").alias("n"),
    )
    return merged.join(pick_geometry(rows, "seed", this), "seed")


def pick_geometry(df: DataFrame, group: str, this: str = "osm") -> DataFrame:
    """(group, geometry_of): the id of the member whose geometry stands for its group: the preferred source's, then a polygon, then the smallest id."""
    rank = F.when(F.col("src") == this, 0).when(F.col("gtype").isin("Polygon", "MultiPolygon"), 1).otherwise(2)
    return df.groupBy(group).agg(F.min_by("id", F.struct(rank, F.col("id"))).alias("geometry_of"))


def merge_road_attrs(base: DataFrame, matches: DataFrame) -> DataFrame:
    """base (id, src, sd, nm, ev, nvdb_id), its gaps filled from its matches (id, rank, src, sd, nm, ev, nvdb_id) in the order of their rank.

    What is there stays; evidence is the strongest of all; src_all names all sources.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(f"_{c}")
    other = matches.groupBy("id").agg(first("sd"), first("nm"), first("nvdb_id"), F.max(text.evidence_rank(F.col("ev"))).alias("_ev"), F.collect_set("src").alias("_src"))
    out = base.join(other, "id", "left")
    return out.select(
        "id",
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("sd", "nm", "nvdb_id")],
        text.evidence_of_rank(F.greatest(text.evidence_rank(F.col("ev")), F.coalesce("_ev", F.lit(0)))).alias("ev"),
        F.array_sort(F.array_distinct(F.concat(F.array("src"), F.coalesce("_src", F.array().cast("array<string>"))))).alias("src_all"),
    )


def apply_road_matches(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """Historical roads (id, src, nm, sd, geometry) under their matches (id, other, lss, hausdorff, change): the modern road's geometry and name, its score and change.

    Unmatched roads keep their own geometry and name and have no change.
    """
    found = matches.join(new.select(F.col("id").alias("other"), F.col("nm").alias("_nm"), F.col("src").alias("_src"), F.col("geometry").alias("_geometry")), "other")
    out = old.join(found, "id", "left")
    return out.select(
        "id", "sd",
        F.coalesce("_geometry", "geometry").alias("geometry"),
        F.coalesce("_nm", "nm").alias("nm"),
        F.round("lss", 3).alias("match_score"),
        F.round("hausdorff", 2).alias("hausdorff"),
        "change",
        F.array_sort(F.array_compact(F.array_distinct(F.array("src", "_src")))).alias("src_all"),
    )


def reconcile(df: DataFrame, order: tuple[str, ...] = ("sefrak", "matrikkelen"), current: str = "osm") -> DataFrame:
    """One row an id of rows (id, src, geometry, geometry_confidence, sd, ed, map_year).

    Geometry of the highest confidence; the first year that a source of the order has, else the
    oldest map's; the end that a source names, or, where none does and no current source shows
    the feature, the last map's year. `origin` tells where each came from. Ties fall to the smaller source.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("src")), F.lit(0))
    listed = F.when(F.col("sd").isNotNull() & (rank > 0), F.struct(rank, F.col("sd")))
    agg = df.groupBy("id").agg(
        F.min_by(F.struct("geometry", "src"), F.struct(-F.col("geometry_confidence"), F.col("src"))).alias("g"),
        F.min_by(F.struct("sd", "src"), listed).alias("named"),
        F.min_by(F.struct(F.col("map_year").alias("sd"), "src"), F.when(F.col("map_year").isNotNull(), F.struct("map_year", "src"))).alias("drawn"),
        F.max(F.when(F.col("src") != current, F.col("ed"))).alias("ed"),
        F.max("map_year").alias("last"),
        F.bool_or(F.col("src") == current).alias("stands"),
    )
    guess = F.when(~F.col("stands"), F.col("last"))
    return agg.select(
        "id",
        F.col("g.geometry").alias("geometry"),
        F.coalesce("named.sd", "drawn.sd").alias("sd"),
        F.coalesce(F.col("ed"), guess).alias("ed"),
        F.struct(F.col("g.src").alias("geometry"), F.coalesce("named.src", "drawn.src").alias("start_date"), F.when(F.col("ed").isNotNull(), "source").when(guess.isNotNull(), "map").alias("end_date")).alias("origin"),
    )
