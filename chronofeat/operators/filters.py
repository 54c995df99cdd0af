"""As-of-year and source filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Years from which undated buildings and roads count as there.
UNDATED_BUILDINGS, UNDATED_ROADS = 1960, 2000


def visible(year: Column | int, end_inclusive: bool = True) -> Column:
    """Started by the year or undated, and not ended before it."""
    year = F.lit(year) if isinstance(year, int) else year
    ends = F.col("ed") >= year if end_inclusive else F.col("ed") > year
    return (F.col("sd").isNull() | (F.col("sd") <= year)) & (F.col("ed").isNull() | ends)


def as_of(df: DataFrame, year: int, end_inclusive: bool = True) -> DataFrame:
    """Rows visible in a year; undated ones always."""
    return df.where(visible(year, end_inclusive))


def buildings_as_of(df: DataFrame, year: int, fallback: int = UNDATED_BUILDINGS) -> DataFrame:
    """Dated rows by their interval, its end included; rows without a start only from the fallback year on."""
    return df.where((F.coalesce("sd", F.lit(fallback)) <= year) & (F.col("ed").isNull() | (F.col("ed") >= year)))


def roads_as_of(df: DataFrame, year: int, fallback: int = UNDATED_ROADS) -> DataFrame:
    """As buildings, but the end year excluded."""
    return df.where((F.coalesce("sd", F.lit(fallback)) <= year) & (F.col("ed").isNull() | (F.col("ed") > year)))


def filter_sources(df: DataFrame, enabled: Iterable[str] | None, column: str = "src") -> DataFrame:
    """Rows of the enabled sources; None is all of them, and none is none."""
    return df if enabled is None else df.where(F.col(column).isin(list(enabled)) if (enabled := list(enabled)) else F.lit(False))


def filter_ml_sources(df: DataFrame, enabled: Iterable[str] | None) -> DataFrame:
    """Rows whose detected sub-source is enabled, or that have none."""
    return df if enabled is None else df.where(F.col("ml_src").isNull() | F.col("ml_src").isin(list(enabled)))


def filter_dual(df: DataFrame, year: int, date_sources: Iterable[str], snapshots: Iterable[str], fallback: int = UNDATED_BUILDINGS) -> DataFrame:
    """Rows of dated sources as of the year, and rows of snapshot sub-sources whatever the year."""
    dated, snapshots = list(date_sources), list(snapshots)
    there = (F.coalesce("sd", F.lit(fallback)) <= year) & (F.col("ed").isNull() | (F.col("ed") >= year))
    first = F.col("src").isin(dated) & there if dated else F.lit(False)
    second = (F.col("src") == "ml") & F.col("ml_src").isin(snapshots) if snapshots else F.lit(False)
    return df.where(F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False)))


def filter_road_sources(df: DataFrame, sources: Iterable[str], ml_sources: Iterable[str] | None = None) -> DataFrame:
    """Rows of the enabled sources; detected ones only of the enabled maps."""
    sources = list(sources)
    named = F.col("src").isin([s for s in sources if s != "ml"]) if [s for s in sources if s != "ml"] else F.lit(False)
    ml = F.lit("ml" in sources) & (F.col("src") == "ml")
    if ml_sources is not None:
        ml &= F.col("ml_src").isin(list(ml_sources))
    return df.where(F.coalesce(named, F.lit(False)) | F.coalesce(ml, F.lit(False)))


def filter_types(df: DataFrame, types: Iterable[str] | None, column: str = "rt") -> DataFrame:
    return df if types is None else df.where(F.col(column).isin(list(types)))


def filter_sd_range(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows that start in the range, ends included, or are undated; without bounds all rows."""
    if low is None and high is None:
        return df
    return df.where(F.col("sd").isNull() | F.col("sd").between(low if low is not None else -9999, high if high is not None else 9999))


def era_gate(df: DataFrame, year: int) -> DataFrame:
    """From 1950 on all rows; from 1900 undated rows and evidence h or m; before that only h."""
    if year >= 1950:
        return df
    return df.where(F.col("sd").isNull() | F.col("ev").isin("h", "m")) if year >= 1900 else df.where(F.col("ev") == "h")


def in_bbox(df: DataFrame, west: float, south: float, east: float, north: float, limit: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    found = df.where(F.col(x).between(west, east) & F.col(y).between(south, north))
    return found if limit is None else found.limit(limit)


def filter_estimates(df: DataFrame, min_year: int | None = None, max_year: int | None = None, min_confidence: float | None = None) -> DataFrame:
    """Rows of estimates within the given bounds."""
    for bound, test in ((min_year, lambda v: F.col("start_year") >= v), (max_year, lambda v: F.col("start_year") <= v), (min_confidence, lambda v: F.col("confidence") >= v)):
        if bound is not None:
            df = df.where(test(bound))
    return df


def filter_keywords(df: DataFrame, columns: list[str], words: Iterable[str]) -> DataFrame:
    """Rows of which some column holds some word, in any case."""
    joined = F.lower(F.concat_ws(" ", *columns))
    found = F.lit(False)
    for w in words:
        found |= joined.contains(w.lower())
    return df.where(found)


def split_current(df: DataFrame, column: str = "status", removed: Iterable[str] = ("removed", "demolished")) -> tuple[DataFrame, DataFrame]:
    """(current rows, removed rows)."""
    gone = F.coalesce(F.col(column).isin(list(removed)), F.lit(False))
    return df.where(~gone), df.where(gone)


def valid_temporal(df: DataFrame, now: int) -> DataFrame:
    """Rows that start by their end and by now, and end by ten years from now; missing years pass."""
    ok = (F.coalesce(F.col("sd") <= F.col("ed"), F.lit(True))) & F.coalesce(F.col("sd") <= now, F.lit(True)) & F.coalesce(F.col("ed") <= now + 10, F.lit(True))
    return df.where(ok)


def filter_evidence(df: DataFrame, least: str) -> DataFrame:
    return df.where(text.meets(F.col("ev"), least))


def filter_min_size(df: DataFrame, limits: dict[str, float], cls: str = "class", size: str = "size") -> DataFrame:
    """Rows at least as large as their class asks; classes without a limit pass."""
    least = F.coalesce(F.element_at(text.map_literal(limits), F.col(cls)), F.lit(0.0))
    return df.where(F.col(size) >= least)


def scan(df: DataFrame, columns: Iterable[str] | None = None, *, sources: Iterable[str] | None = None, dated: bool | None = None, low: int | None = None, high: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a feature table that keep the predicates given, some columns of them, any `limit` of them at most. Predicates reach the Parquet scan."""
    if sources is not None:
        df = df.where(F.col("src").isin(list(sources)))
    if dated is not None:
        df = df.where(F.col("sd").isNotNull() if dated else F.col("sd").isNull())
    if low is not None:
        df = df.where(F.col("sd") >= low)
    if high is not None:
        df = df.where(F.col("sd") <= high)
    df = df.select(*columns) if columns is not None else df
    return df if limit is None else df.limit(limit)
