"""Rows of the common feature schema, and normalisers that don't belong to one source's own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Fields of heritage records that may hold a date or a name, in the order they are tried; words of their kind and the road class that each means.
HERITAGE_DATES = ("datering", "dateringsperiode", "byggeår", "anleggsår", "førstegangsregistrering", "opprinnelig_funksjon_tid", "tidligste_dato", "eldste_datering")
HERITAGE_NAMES = ("navn", "name", "kulturminneNavn", "lokalitetsNavn")
HERITAGE_KINDS = (("kongevei|riksvei", "primary"), ("postvei", "secondary"), ("pilegrimsled|ferdselsåre", "path"), ("sti", "track"))
#: Keys of a start and an end in tables of any source.
START_KEYS, END_KEYS = ("start_date", "start_year", "year"), ("end_date", "end_year", "demolished")
#: Sources whose rows are strong evidence, with a date or without; short codes of sources.
STRONG, STRONG_DATED = ("sefrak", "matrikkelen", "ml_1880_matched"), ("osm",)
CODES = {"sefrak": "sef", "osm": "osm", "osm_assumed": "osm", "ml_1880_matched": "ml", "ml_1880_not_detected": "osm", "matrikkelen": "mat"}
#: Ids of land-cover classes.
BACKGROUND, BUILDING, ROAD, WATER, FOREST = 0, 1, 2, 3, 4


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, null where the table lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def _filled(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def to_feature(df: DataFrame, source: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """(src_id, geometry, props): the common building row as JSON without nulls and empty words, evidence `l` where it is missing.

    df has src_id and geometry, and what it knows of sd, ed, ev, bt, nm; `raw` columns go under `_raw`.
    """
    return _feature(df, source, {"sd": _has(df, "sd", "int"), "ed": _has(df, "ed", "int"), "ev": F.coalesce(_filled(_has(df, "ev")), F.lit("l")), "bt": _filled(_has(df, "bt")), "nm": _filled(_has(df, "nm"))}, raw)


def to_road_feature(df: DataFrame, source: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """to_feature() for roads: with rt, len to one decimal (half to even) and nvdb_id in place of a building's type."""
    own = {"rt": _filled(_has(df, "rt")), "len": F.bround(_has(df, "len", "double"), 1), "nvdb_id": _has(df, "nvdb_id", "long")}
    return _feature(df, source, {"sd": _has(df, "sd", "int"), "ed": _has(df, "ed", "int"), "ev": F.coalesce(_filled(_has(df, "ev")), F.lit("l")), "nm": _filled(_has(df, "nm")), **own}, raw)


def _feature(df: DataFrame, source: str, values: dict[str, Column], raw: tuple[str, ...]) -> DataFrame:
    props = [F.lit(source).alias("_src"), F.col("src_id").alias("_src_id"), *[v.alias(k) for k, v in values.items()]]
    if raw:
        props.append(F.struct(*[F.col(f"`{c}`") for c in raw]).alias("_raw"))
    return df.select("src_id", "geometry", F.to_json(F.struct(*props)).alias("props"))


def normalize_heritage(df: DataFrame) -> DataFrame:
    """Heritage roads (src_id, geometry, sd, ev, nm, rt, description) of records with lines.

    The year is that of the first date field with one, else the first year 1000 to 1999 in the
    description; descriptions are cut to 500 characters. Evidence is `h`.
    """
    # a year in a description is not held to the window of valid years
    told = F.nullif(F.regexp_extract(F.coalesce(_has(df, "beskrivelse"), F.lit("")), r"\b(1[0-9]{3})\b", 1), F.lit("")).cast("int")
    kind = F.lower(F.concat_ws(" ", *[_has(df, c) for c in ("vernetype", "kategori", "art", "funksjon")]))
    rt = F.lit("historical")
    for words, road in reversed(HERITAGE_KINDS):
        rt = F.when(kind.rlike(words), road).otherwise(rt)
    lines = df.where(F.col("geometry.gtype").isin("LineString", "MultiLineString"))
    return lines.select(
        F.concat(F.lit("kult_"), F.coalesce(*[_filled(_has(df, c)) for c in ("kulturminneId", "id", "lokalitetId")])).alias("src_id"),
        "geometry",
        F.coalesce(*[dates.parse_year(_has(df, c)) for c in HERITAGE_DATES], told).alias("sd"),
        F.lit("h").alias("ev"),
        F.coalesce(*[_filled(_has(df, c)) for c in HERITAGE_NAMES]).alias("nm"),
        rt.alias("rt"),
        F.substring(_has(df, "beskrivelse"), 1, 500).alias("description"),
    )


def _any_year(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """The first valid year, 1700 to 2100, of several columns: the whole value, else the first such year in it."""

    def of(value: Column) -> Column:
        whole = dates.within_window(F.when(value.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(value).cast("int")), 1700, 2100)
        return F.coalesce(whole, F.nullif(F.regexp_extract(value, r"\b(1[7-9]\d{2}|20\d{2})\b", 1), F.lit("")).cast("int"))

    return F.coalesce(*[of(_has(df, k).cast("string")) for k in keys])


def normalize_any(df: DataFrame, source: str, this_year: int, default_start: int | None = None) -> DataFrame:
    """df of any source with start_date, end_date, source, feature_class (kept if there) and confidence, 1 where it is missing.

    Rows go whose start lies after their end or this year, or whose end lies more than ten years
    ahead. default_start dates rows without a year, as map objects that stand today.
    """
    start, end = F.coalesce(_any_year(df, START_KEYS), F.lit(default_start).cast("int")), _any_year(df, END_KEYS)
    rest = [c for c in df.columns if c not in (*START_KEYS, *END_KEYS, "source", "confidence")]
    out = df.select(*[F.col(f"`{c}`") for c in rest], start.alias("start_date"), end.alias("end_date"), F.lit(source).alias("source"), F.coalesce(_has(df, "confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    keep = F.coalesce(F.col("start_date") <= F.col("end_date"), F.lit(True)) & F.coalesce(F.col("start_date") <= this_year, F.lit(True)) & F.coalesce(F.col("end_date") <= this_year + 10, F.lit(True))
    return out.where(keep)


def to_evidence_schema(df: DataFrame) -> DataFrame:
    """(bid, src, ev, sd, mlc, bt, nm) of buildings (osm_id, source, start_date, sefrak_period, ml_confidence, building, name).

    Only strong evidence shows its year; a detection of 1880 without one shows 1880; a registry
    period gives its first year and is strong.
    """
    source = F.coalesce("source", F.lit("osm_assumed"))
    year = dates.parse_year(F.col("start_date"))
    dated = year.isNotNull() & source.isin("sefrak", "osm", "matrikkelen")
    strong = source.isin(*STRONG) | (source.isin(*STRONG_DATED) & dated)
    period = F.nullif(F.regexp_extract(F.coalesce("sefrak_period", F.lit("")), r"^(\d{4})\s*[-–]\s*(\d{4})$", 1), F.lit("")).cast("int")
    return df.select(
        F.col("osm_id").alias("bid"),
        F.when(period.isNotNull(), "sef").otherwise(F.coalesce(F.element_at(text.map_literal(CODES), source), F.lit("unk"))).alias("src"),
        F.when(period.isNotNull() | strong, "h").otherwise("l").alias("ev"),
        F.coalesce(period, F.when(strong, F.coalesce(year, F.when(source == "ml_1880_matched", 1880)))).alias("sd"),
        F.when(source == "ml_1880_matched", F.bround(F.coalesce(F.col("ml_confidence").cast("double"), F.lit(0.8)), 2)).alias("mlc"),
        F.col("building").alias("bt"),
        _filled(F.col("name")).alias("nm"),
    )


def to_demolished(df: DataFrame) -> DataFrame:
    """Detections (existed_in, confidence, geometry) that no building stands for any more: strong evidence of the map's year, 1880 without one."""
    return df.select("geometry", F.coalesce("existed_in", F.lit(1880)).alias("sd"), F.lit("h").alias("ev"), F.lit("ml").alias("src"), F.lit(1).alias("dem"), F.coalesce("confidence", F.lit(0.7)).alias("mlc"))


def classify_tags(tags: Column) -> Column:
    """The land-cover class of a map object: water, building, road, forest, else background, in this order."""
    has = lambda k: F.map_contains_key(tags, F.lit(k))
    natural, use = F.element_at(tags, F.lit("natural")), F.element_at(tags, F.lit("landuse"))
    water = has("waterway") | F.coalesce(natural == "water", F.lit(False))
    forest = F.coalesce(natural.isin("wood", "tree_row"), F.lit(False)) | F.coalesce(use.isin("forest", "wood"), F.lit(False))
    return F.when(water, WATER).when(has("building"), BUILDING).when(has("highway"), ROAD).when(forest, FOREST).otherwise(BACKGROUND)
