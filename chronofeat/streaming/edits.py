"""Incremental jobs on keyed state: edits merged into snapshots, deduplicated ingest, keys processed once; edit activity by window."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.resolve import latest_per_key

REQUIRED = ("fid", "edited_at")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk and in the checkpoint, not on the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Winner(StatefulProcessor):
    """Of the rows of a key the last by `_order` if it comes after the one before it; or, with `first`, its very first row and no other. One value a key is kept."""

    def __init__(self, first: bool):
        self.first = first

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        known = tuple(self.known.get()[0]) if self.known.exists() else None
        if self.first and known is not None:
            return
        best = (min if self.first else max)(rows, key=lambda r: r["_order"])
        if known is None or tuple(best["_order"]) > known:
            self.known.update((list(best["_order"]),))
            yield best

    def close(self) -> None:
        pass


def _number(df: DataFrame, c: str) -> Column:
    """A column of an order as a whole number; null comes first."""
    kind = df.schema[c].dataType
    at = F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(c).cast("long")
    return F.coalesce(at, F.lit(-(1 << 63)))


def winners(rows: DataFrame, key: str, order: tuple[str, ...], first: bool = False) -> DataFrame:
    """A stream of the rows that count for their key when they come: each newer last one, or the very first one.

    The state is one value a key, kept for good: a key that returns after any time is known.
    Rows of equal order count once.
    """
    ordered = rows.withColumn("_order", F.array(*[_number(rows, c) for c in order]))
    found = ordered.groupBy(key).transformWithState(Winner(first), ordered.schema, "Update", "None")
    return found.drop("_order")


def _names(spark: SparkSession, root: str) -> list[str]:
    """Folders under root that were written wholly."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    return [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def results(spark: SparkSession, root: str) -> DataFrame | None:
    """What all batches have written under root."""
    found = [f"{root}/{n}" for n in _names(spark, root)]
    return spark.read.parquet(*found) if found else None


def _start(rows: DataFrame, step, checkpoint: str) -> StreamingQuery:
    with _rocks(rows.sparkSession):
        return rows.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_edits(edits: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the last edit of each feature: a batch writes only the features that it changes; see snapshot().

    Edits without a required field are left out; an edit is evidence h. An edit older than the one
    that a feature has, as one that comes late or again, changes nothing. A batch that runs again
    overwrites its own folder, so results are exactly-once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("ev", F.lit("h")).write.mode("overwrite").parquet(f"{root}/{number}")

    return _start(winners(edits.dropna(subset=list(REQUIRED)), "fid", ("edited_at", "event_id")), step, checkpoint)


def snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The last edit of each feature over the changes of all batches."""
    rows = results(spark, root)
    return None if rows is None else latest_per_key(rows, ["fid"], "edited_at", "event_id")


def dedup_ingest(rows: DataFrame, key: str, at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the first row of each key, by `at` within a batch, once and for all; rows without a key are all appended."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    kept = winners(rows.where(F.col(key).isNotNull()), key, (at,), first=True).select(*rows.columns)
    return _start(kept.union(rows.where(F.col(key).isNull())), step, checkpoint)


def process_once(rows: DataFrame, key: str, work, root: str, checkpoint: str, order: tuple[str, ...]) -> StreamingQuery:
    """Write work(batch) for the first rows, by `order`, of keys that never came before; work is per batch, and no earlier result is read."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{root}/{number}")

    return _start(winners(rows, key, order, first=True), step, checkpoint)


def edit_activity(edits: DataFrame, at: str = "edited_at", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Edits of each kind in each window; late ones beyond the delay are dropped. Works on streams and tables."""
    rows = edits.withWatermark(at, delay) if edits.isStreaming else edits
    return rows.groupBy(F.window(at, window).alias("w"), "note").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "note", "n")
