"""Deduplication and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def dedup_keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    return kept.unionByName(df.where(F.col(key).isNull()))


def dedup_keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; rows without a key all stay."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    return kept.unionByName(df.where(F.col(key).isNull()))


def new_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def dedup_by_content(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row of each id; the first id column that is there counts, else the row's content."""
    content = F.sha2(F.to_json(F.struct("*")), 256)
    return df.withColumn("_id", F.coalesce(*[F.col(c).cast("string") for c in ids], content)).dropDuplicates(["_id"]).drop("_id")


def orphans(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of either side, and whether the other one lacks it."""
    left, right = a.select(key).withColumn("_a", F.lit(True)), b.select(key).withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").otherwise("both")
    return left.join(right, key, "full").select(key, state.alias("state"))


def replace_source(df: DataFrame, fresh: DataFrame, source: str, column: str = "src") -> DataFrame:
    """df with all rows of one source replaced by fresh ones."""
    return df.where(~F.coalesce(F.col(column) == source, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def even_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """About n rows evenly spaced in an order: every k-th, k the rows divided by n. The order should leave no ties."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    offset, offsets = 0, []
    for p, k in sorted(map(tuple, ranged.groupBy("_p").count().collect())):  # a row a partition
        offsets.append((p, offset))
        offset += k
    step = max(1, offset // max(n, 1))
    before = df.sparkSession.createDataFrame(offsets, "_p int, _before long")
    return ranged.join(F.broadcast(before), "_p").where((F.col("_before") + F.col("_k")) % step == 0).drop("_p", "_k", "_before").orderBy(*order).limit(n)


def by_priority(df: DataFrame, catalog: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of their source's priority (catalog: src, priority), unlisted sources last, then in an explicit order. Spark broadcasts a catalogue that it knows to be small."""
    return df.join(catalog.select("src", "priority"), "src", "left").orderBy(F.coalesce("priority", F.lit(999)), *order)


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order, as the oldest or the latest ones."""
    return df.orderBy(*order).limit(n)
