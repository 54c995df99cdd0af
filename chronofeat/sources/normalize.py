"""Source tables to the common schemas of buildings, roads and water; one function a source, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, text

# ---------------------------------------------------------------- fixed values

#: Map tags: road class of a highway value, keys that may hold a date.
HIGHWAYS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary",
    "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential", "unclassified": "residential", "living_street": "residential", "service": "service",
    "pedestrian": "path", "footway": "path", "cycleway": "path", "path": "path", "track": "track",
}
ROAD_DATES = ("start_date", "construction_date", "nvdb:date", "opening_date")
BUILDING_DATES = ("start_date", "construction_date", "building:start_date")
#: Cadastre: category of each building code.
CADASTRE = {
    "111": "residential", "112": "residential", "113": "residential", "121": "residential", "122": "residential", "123": "residential",
    "131": "residential", "133": "residential", "135": "residential", "136": "residential", "141": "residential", "142": "residential",
    "143": "residential", "144": "residential", "145": "residential", "146": "residential",
    "211": "industrial", "212": "industrial", "214": "industrial", "216": "industrial", "219": "industrial",
    "311": "commercial", "312": "commercial", "313": "commercial", "319": "commercial", "321": "commercial", "322": "commercial",
    "323": "commercial", "329": "commercial",
    "611": "public", "612": "public", "613": "public", "614": "public", "615": "public", "616": "public",
    "619": "public", "621": "public", "623": "public", "629": "public", "641": "public", "642": "public",
    "651": "public", "661": "public", "662": "public",
    "671": "religious", "672": "religious", "673": "religious", "674": "religious", "675": "religious",
    "241": "agricultural", "243": "agricultural", "244": "agricultural", "245": "agricultural", "248": "agricultural",
    "441": "transport", "449": "transport",
    "161": "leisure", "162": "leisure", "163": "leisure", "171": "leisure", "181": "leisure", "182": "leisure",
    "183": "leisure",
}
#: Registry: words of a building's function and codes that tell its category, in the order they are tried; first and last year of time codes.
FUNCTIONS = (("residential", "bolig|hus|bu"), ("agricultural", "fjøs|løe|stall|låve|naust"), ("commercial", "fabrikk|verksted|butikk|handel"), ("religious", "kirke|kapell|bedehus"), ("ruin", "ruin|rest|tomt"))
FUNCTION_CODES = (("residential", ("111", "112", "113", "171")), ("agricultural", ("151", "152", "153", "161", "162")), ("ruin", ("249",)))
TIME_CODES = {
    "166": (1660, 1700), "170": (1700, 1710), "171": (1710, 1720), "172": (1720, 1730), "173": (1730, 1740), "174": (1740, 1750),
    "175": (1750, 1760), "176": (1760, 1770), "177": (1770, 1780), "178": (1780, 1790), "179": (1790, 1800), "180": (1800, 1810),
    "181": (1810, 1820), "182": (1820, 1830), "183": (1830, 1840), "184": (1840, 1850), "185": (1850, 1860), "186": (1860, 1870),
    "187": (1870, 1880), "188": (1880, 1890), "189": (1890, 1900), "190": (1900, 1920), "191": (1920, 1945),
}
#: Road database: classes by category and by type, name prefixes of categories.
CATEGORIES = {"E": "motorway", "R": "primary", "F": "secondary", "K": "tertiary", "P": "residential", "S": "track"}
ROAD_TYPES = {"kanalisertVeg": "motorway", "enkelBilveg": "secondary", "rampe": "service", "rundkjøring": "service", "gangOgSykkelveg": "path", "sykkelveg": "path", "gangveg": "path", "gågate": "path", "fortau": "path"}
PREFIXES = {"E": "E", "R": "Rv", "F": "Fv", "K": "Kv"}
WATER_TYPES = ("fjord", "lake", "river", "harbor", "canal")
CLASSES = ("building", "road", "railway", "water", "forest")


# ---------------------------------------------------------------- validation


def errors(**rules: Column) -> Column:
    """The names of the rules that a row breaks; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def validate(df: DataFrame, mode: str = "drop", **rules: Column) -> DataFrame:
    """Rows that keep all rules. mode "fail" makes the job fail at a row that doesn't; "mark" keeps all rows with their `errors`."""
    marked = df.withColumn("errors", errors(**rules))
    if mode == "mark":
        return marked
    if mode == "fail":
        return marked.where(F.assert_true(F.size("errors") == 0, F.concat(F.lit("broken rules: "), F.array_join("errors", ", "))).isNull()).drop("errors")
    return marked.where(F.size("errors") == 0).drop("errors")


def reject_counts(marked: DataFrame) -> DataFrame:
    """Rows that broke each rule."""
    return marked.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def building_rules() -> dict[str, Column]:
    return {"src_id": F.col("src_id").isNotNull(), "geometry": F.col("geometry").isNotNull(), "ev": F.col("ev").isin("h", "m", "l")}


def road_rules() -> dict[str, Column]:
    kinds = F.col("geometry.gtype").isin("LineString", "MultiLineString")
    classes = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "path", "track", "historical", "unknown")
    return {"geometry": kinds, "ev": F.col("ev").isin("h", "m", "l"), "rt": F.col("rt").isin(*classes), "order": F.col("sd").isNull() | F.col("ed").isNull() | (F.col("sd") <= F.col("ed"))}


# ---------------------------------------------------------------- map elements


def assemble_ways(ways: DataFrame, nodes: DataFrame, kind: str = "polygon") -> DataFrame:
    """ways (id, nodes, tags) with their geometry: nodes in order, unknown ones left out; polygons need four points and are closed, lines two."""
    at = ways.select("id", F.posexplode("nodes").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: geo.point(p["lon"], p["lat"]))
    lines = at.groupBy("id").agg(line.alias("line"))
    if kind == "polygon":
        first, last = F.col("line")[0], F.element_at("line", -1)
        lines = lines.where(F.size("line") >= 4).withColumn("line", F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("line")).otherwise(F.concat("line", F.array(first))))
    else:
        lines = lines.where(F.size("line") >= 2)
    shape = F.struct(F.lit("Polygon" if kind == "polygon" else "LineString").alias("gtype"), F.array(F.array("line")).alias("parts"))
    return ways.join(lines.select("id", shape.alias("geometry")), "id")


def assemble_relations(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """relations (id, members, tags) with the polygon or polygons of their outer ways (id, geometry); one with an unknown member is left out."""
    parts = relations.select("id", F.posexplode(F.filter("members", lambda m: (m["type"] == "way") & (m["role"] == "outer"))).alias("pos", "m"))
    found = parts.join(ways.select(F.col("id").alias("ref"), "geometry"), F.col("m.ref") == F.col("ref"), "left")
    whole = found.groupBy("id").agg(F.every(F.col("geometry").isNotNull()).alias("known"), F.array_sort(F.collect_list(F.struct("pos", F.col("geometry.parts")[0].alias("part")))).alias("parts")).where("known")
    kind = F.when(F.size("parts") == 1, "Polygon").otherwise("MultiPolygon")
    return relations.join(whole.select("id", F.struct(kind.alias("gtype"), F.transform("parts", lambda p: p["part"]).alias("parts")).alias("geometry")), "id")


def _first_year(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[dates.parse_year(F.element_at(tags, k)) for k in keys])


def normalize_osm(df: DataFrame) -> DataFrame:
    """Buildings of map ways (id, tags, geometry): year of the first date tag that parses, then evidence h, else l."""
    year = _first_year(F.col("tags"), BUILDING_DATES)
    return df.select(F.lit("osm").alias("src"), F.concat(F.lit("way/"), "id").alias("src_id"), year.alias("sd"), F.when(year.isNotNull(), "h").otherwise("l").alias("ev"), F.element_at("tags", "building").alias("bt"), F.element_at("tags", "name").alias("nm"), "geometry")


def normalize_osm_roads(df: DataFrame) -> DataFrame:
    """Roads of map ways: class of the highway tag, evidence h for a date of the road database, m for another, else l."""
    tags = F.col("tags")
    year = _first_year(tags, ROAD_DATES)
    ev = F.when(year.isNull(), "l").when(F.element_at(tags, "nvdb:date").isNotNull(), "h").otherwise("m")
    kind = F.coalesce(F.element_at(text.map_literal(HIGHWAYS), F.element_at(tags, "highway")), F.lit("unknown"))
    return df.select(F.lit("osm_roads").alias("src"), F.concat(F.lit("way/"), "id").alias("src_id"), year.alias("sd"), ev.alias("ev"), kind.alias("rt"), text.first_tag(tags, ("name", "ref")).alias("nm"), F.bround(geo.line_length_m(F.col("geometry")), 1).alias("len"), "geometry")


def water_type(tags: Column) -> Column:
    """harbor, lake, river, canal, or fjord for all else."""
    of = lambda k: F.coalesce(F.element_at(tags, k), F.lit(""))
    return (
        F.when(of("harbour") != "", "harbor")
        .when((of("natural") == "water") & of("water").isin("lake", "reservoir"), "lake")
        .when((of("natural") == "water") & (of("water") == "river"), "river")
        .when(of("waterway").isin("river", "stream", "brook"), "river")
        .when(of("waterway") == "canal", "canal")
        .when(of("landuse") == "reservoir", "lake")
        .otherwise("fjord")
    )


def infer_class(tags: Column, gtype: Column) -> Column:
    """building, road, railway, water, forest or other: named outright, by map tags, or by geometry."""
    has = lambda *keys: F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in keys]))
    named = F.lower(text.first_tag(tags, ("feature_class", "class", "type", "category")))
    out = F.when(F.lit(False), "")
    for c in CLASSES:
        out = out.when(named.contains(c), c)
    return (
        out.when(has("building"), "building")
        .when(has("highway", "road", "street"), "road")
        .when(has("railway", "rail"), "railway")
        .when(F.lower(F.element_at(tags, "natural")).isin("water", "lake", "river"), "water")
        .when(F.lower(F.element_at(tags, "landuse")).isin("forest", "wood"), "forest")
        .when(gtype.isin("Polygon", "MultiPolygon"), "building")
        .when(gtype.isin("LineString", "MultiLineString"), "road")
        .otherwise("other")
    )


# ---------------------------------------------------------------- registers


def building_type(function: Column, code: Column) -> Column:
    """A registry building's category by its function's words, else its code."""
    out = F.when(F.lit(False), "")
    for name, words in FUNCTIONS:
        out = out.when(F.lower(function).rlike(words), name)
    for name, codes in FUNCTION_CODES:
        out = out.when(F.trim(code).isin(*codes), name)
    return out


def decode_time_code(code: Column) -> Column:
    """struct(start, end, label) of a registry time code; null for an unknown one."""
    table = text.map_literal({k: v[0] for k, v in TIME_CODES.items()}), text.map_literal({k: v[1] for k, v in TIME_CODES.items()})
    start, end = (F.element_at(t, F.trim(code)) for t in table)
    label = F.when(start == 1660, "before 1700").otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), label.alias("label")))


def normalize_registry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buildings, rejected rows with a reason) of registry points: middle year of the building period, demolished for status 0, degrees from UTM."""
    ends = F.array(F.struct(dates.parse_year(F.col("start_date")).alias("a"), dates.parse_year(F.col("end_date")).alias("b")))
    # each date is parsed once, whatever the number of its uses
    year = F.get(F.transform(ends, lambda p: F.when(p["b"] > p["a"], dates.mid_year(p["a"], p["b"])).otherwise(p["a"])), F.lit(0))
    reason = F.when(F.col("easting").isNull() | F.col("northing").isNull(), "no_geometry").when(F.coalesce("sefrak_id", F.lit("")) == "", "no_id").when(F.col("_sd").isNull(), "no_date")
    rows = df.withColumn("_sd", year).withColumn("reason", reason)
    place = geo.utm32_to_lonlat(F.col("easting"), F.col("northing"))
    good = rows.where("reason IS NULL").select(
        F.lit("sefrak").alias("src"), F.col("sefrak_id").alias("src_id"), F.col("_sd").alias("sd"), F.lit("h").alias("ev"),
        building_type(F.coalesce("original_function_name", "current_function_name"), F.col("bygningstype")).alias("bt"), F.col("name").alias("nm"),
        (F.coalesce("sefrak_status", F.lit("1")) == "0").alias("demolished"), F.struct(F.lit("Point").alias("gtype"), F.array(F.array(F.array(place))).alias("parts")).alias("geometry"),
    )
    return good, rows.where("reason IS NOT NULL").drop("_sd")


def normalize_cadastre(df: DataFrame) -> DataFrame:
    """Cadastre buildings: the building number or else the local id, category of the code, no years, evidence h."""
    return df.select(F.lit("fkb_bygning").alias("src"), F.coalesce("bygningsnummer", "lokalId").alias("src_id"), F.lit(None).cast("int").alias("sd"), F.lit("h").alias("ev"), F.element_at(text.map_literal(CADASTRE), F.trim("bygningstype")).alias("bt"), "geometry")


def normalize_listings(df: DataFrame) -> DataFrame:
    """Listings matched to map buildings: their reference, year and street (the address before its comma)."""
    return df.select(F.lit("finn").alias("src"), F.concat(F.lit("finn-"), "finn_code").alias("src_id"), "osm_ref", F.col("year_built").cast("int").alias("sd"), F.lit("h").alias("ev"), F.trim(F.split("address", ",")[0]).alias("nm"), "geometry")


def normalize_manual(df: DataFrame, types: tuple[str, ...] = ("residential", "commercial", "industrial", "religious", "public", "agricultural")) -> DataFrame:
    """Entries made by hand: known uses become types, evidence m unless given, provenance without nulls."""
    return df.select(F.lit("manual").alias("src"), "src_id", "osm_ref", "sd", "ed", F.coalesce("ev", F.lit("m")).alias("ev"), F.when(F.col("use").isin(*types), F.col("use")).alias("bt"), text.without_nulls(F.col("provenance")).alias("provenance"), "geometry")


def normalize_ml(df: DataFrame, catalog: DataFrame, classes: tuple[str, ...] = ("building",)) -> DataFrame:
    """Detections of the given classes: present by their map's year, from the catalogue or else the source id; evidence by confidence."""
    year = F.coalesce("reference_year", dates.map_year(F.col("src")))
    rows = df.where(F.col("class").isin(*classes)).join(catalog.select("src", "reference_year"), "src", "left")
    return rows.select("src", F.concat(F.lit("ml-"), F.col("feature_id")).alias("src_id"), year.cast("int").alias("sd"), text.evidence_from_confidence(F.col("confidence")).alias("ev"), F.col("confidence").alias("mlc"), text.ml_source_code(F.col("src")).alias("ml_src"), "geometry")


def normalize_ml_roads(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Detected roads: lines of class 2, type historical, with their length."""
    rows = df.where((F.col("class_id") == 2) & F.col("geometry.gtype").isin("LineString", "MultiLineString")).withColumn("class", F.lit("road"))
    return normalize_ml(rows, catalog, ("road",)).withColumn("rt", F.lit("historical")).withColumn("len", F.bround(geo.line_length_m(F.col("geometry")), 1))


def normalize_nvdb(df: DataFrame) -> DataFrame:
    """Roads of the national database: type before category, prefixed number as name, construction year or else a start before 2000."""
    kind = F.coalesce(F.element_at(text.map_literal(ROAD_TYPES), F.col("typeVeg")), F.element_at(text.map_literal(CATEGORIES), F.col("vegkategori")), F.lit("unknown"))
    start = dates.year_of_registry_date(F.col("startdato"))
    year = F.coalesce(dates.year_of_registry_date(F.col("construction_year").cast("string")), F.when(start < 2000, start))
    name = F.concat(F.element_at(text.map_literal(PREFIXES), F.col("vegkategori")), F.col("vegnummer").cast("string"))
    return df.where(F.col("geometry.gtype").isin("LineString", "MultiLineString")).select(F.lit("nvdb").alias("src"), F.concat_ws("_", F.lit("nvdb"), "nvdb_id", F.coalesce("segment_id", F.lit(0))).alias("src_id"), kind.alias("rt"), name.alias("nm"), year.alias("sd"), F.when(year.isNotNull(), "h").otherwise("m").alias("ev"), F.bround("lengde", 1).alias("len"), "geometry")


def water_errors(low: int = 1700, high: int = 2030) -> dict[str, Column]:
    """Rules of water rows (sd, ed as text, wtype, geometry)."""
    sd, ed = F.col("sd").try_cast("int"), F.col("ed").try_cast("int")
    return {
        "no_geometry": F.col("geometry").isNotNull(),
        "missing_sd": F.col("sd").isNotNull(),
        "invalid_sd": F.col("sd").isNull() | F.coalesce(sd.between(low, high), F.lit(False)),
        "invalid_ed": F.col("ed").isNull() | F.coalesce(ed.between(low, high), F.lit(False)),
        "ed_not_after_sd": ed.isNull() | sd.isNull() | (ed > sd),
        "invalid_wtype": F.col("wtype").isin(*WATER_TYPES),
    }


def normalize_water(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(water rows, rejected rows by reason): years in the window, end after start, known type; evidence other than h, m or l becomes m."""
    marked = validate(df, "mark", **water_errors())
    good = marked.where(F.size("errors") == 0).select("id", F.col("sd").cast("int").alias("sd"), F.col("ed").cast("int").alias("ed"), "wtype", F.when(F.col("ev").isin("h", "m", "l"), F.col("ev")).otherwise("m").alias("ev"), "geometry")
    return good, reject_counts(marked)


# ---------------------------------------------------------------- other schemas


def to_bound_schema(df: DataFrame) -> DataFrame:
    """sd with its kind (x exact, n not later than, u unknown), source and confidence, sd_max of periods; the end 2025 means none."""
    kind = F.when(F.col("source").isin("sefrak", "finn", "manual", "osm"), "x").when(F.col("source").startswith("ml"), "n").otherwise("u")
    period = dates.parse_year_range(F.col("period"))
    gone = F.coalesce(F.col("status") == "demolished", F.lit(False))
    year = F.when(gone, F.coalesce("existed_in", F.lit(1880))).otherwise(F.coalesce(period["start"], F.when(kind != "u", dates.any_year(F.col("start_date")))))
    end = F.when(gone, 2000).otherwise(F.when(dates.any_year(F.col("end_date")) != 2025, dates.any_year(F.col("end_date"))))
    return df.select("id", year.cast("int").alias("sd"), F.when(~gone, period["end"]).alias("sd_max"), F.when(gone, "n").when(period["start"].isNotNull(), "x").otherwise(kind).alias("sd_t"), F.when(gone, "ml80").when(period["start"].isNotNull(), "sef").otherwise(text.source_code(F.col("source"))).alias("sd_s"), F.when(gone | ((kind == "n") & period["start"].isNull()), F.round(F.coalesce("confidence", F.when(gone, 0.7).otherwise(0.5)), 2)).alias("sd_c"), end.cast("int").alias("ed"), F.when(end.isNotNull(), "s").alias("ed_t"))


def export_buildings(df: DataFrame) -> DataFrame:
    """The compact client schema: short ids and codes, src_all only of several sources, detection fields only of detections."""
    ml = F.col("src").startswith("ml_")
    return df.select(text.feature_code(F.col("src"), F.col("src_id")).alias("bid"), text.source_code(F.col("src")).alias("src"), F.when(F.size("src_all") > 1, F.transform("src_all", text.source_code)).alias("src_all"), "sd", "ed", "ev", F.when(ml, text.ml_source_code(F.col("src"))).alias("ml_src"), F.when(ml, F.col("mlc")).alias("mlc"), "bt", "nm", "repl_by", "geometry")


def export_roads(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The compact road schema, without unsure detections; length in kilometres."""
    kept = df.where(~F.col("src").startswith("ml_") | (F.coalesce("mlc", F.lit(0.0)) >= least))
    return kept.select(text.road_code(F.col("src_id")).alias("rid"), text.source_code(F.col("src")).alias("src"), "rt", "nm", "sd", "ed", "ev", F.round(F.col("len") / 1000, 3).alias("km"), "change", "geometry")


def export_estimates(df: DataFrame, least: float = 0.3) -> DataFrame:
    """Estimates of a confidence and with a year, their source from the id's prefix, evidence from 0.5 and 0.3 on."""
    return df.where(F.col("start_year").isNotNull() & (F.col("confidence") >= least)).select("building_id", F.regexp_extract("building_id", "^([a-z]+)", 1).alias("src"), F.col("start_year").alias("sd"), F.col("end_year").alias("ed"), text.evidence_from_confidence(F.col("confidence"), 0.5, 0.3).alias("ev"), "confidence")


def parse_tile_name(name: Column) -> Column:
    """struct(era, series, year, tile) of `era_series_year_tile.ext`."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    return F.struct(F.get(parts, F.lit(0)).alias("era"), F.get(parts, F.lit(1)).alias("series"), F.try_to_number(F.nullif(F.regexp_extract(stem, r"(?:^|_)(\d{4})(?:_|$)", 1), F.lit("")), F.lit("9999")).cast("int").alias("year"), F.element_at(parts, -1).alias("tile"))


def extract_listing(url: Column, page: Column) -> Column:
    """struct(code, title, lang, amount, year) of a listing page: last number of the url's path, title, language, a money amount, a build year."""
    number = lambda pattern: F.nullif(F.regexp_extract(page, pattern, 1), F.lit(""))
    return F.struct(
        F.nullif(F.regexp_extract(url, r"/(\d+)(?:[/.?#]|$)", 1), F.lit("")).cast("long").alias("code"),
        F.nullif(F.regexp_extract(page, r"(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract(page, r'<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"),
        F.regexp_replace(number(r"([\d  ]+),?-? ?kr"), r"\D", "").cast("long").alias("amount"),
        number(r"(?i)bygge?år\D{0,20}(\d{4})").cast("int").alias("year"),
    )


def normalize_property(df: DataFrame) -> DataFrame:
    """Property rows: year of a month/day/year date, place from UTM, rows without any text left out."""
    place = geo.utm32_to_lonlat(F.col("easting"), F.col("northing"))
    return df.select("property_id", "address", dates.year_of_slashed_date(F.col("built")).alias("sd"), place.alias("place")).where("property_id IS NOT NULL OR address IS NOT NULL")


NORMALIZERS = {"osm": normalize_osm, "osm_roads": normalize_osm_roads, "sefrak": normalize_registry, "fkb_bygning": normalize_cadastre, "finn": normalize_listings, "manual": normalize_manual, "nvdb": normalize_nvdb, "water": normalize_water}
