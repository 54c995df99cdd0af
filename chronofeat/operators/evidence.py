"""Evidence about buildings and the date estimates that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The earliest year of a building, years from which presence says nothing, half widths of weak exact years and of contradictions.
EARLIEST, MODERN, WEAK, CONTRADICTION = 1700, 2020, 10, 20
#: Largest width, confidence and method of an estimate.
WIDTHS = ((0, 0.95, "bounded"), (10, 0.85, "bounded"), (30, 0.7, "range"), (50, 0.5, "range"), (100, 0.35, "estimated"), (None, 0.2, "estimated"))
CENTRE_BANDS = ((0.5, 1870, 0.35), (1.0, 1900, 0.3), (2.0, 1930, 0.25), (4.0, 1960, 0.25), (None, 1975, 0.2))


def registry_evidence(df: DataFrame) -> DataFrame:
    """Exact years of a registry, confidence 0.95."""
    return _evidence(df, "exact", exact=F.col("sd"), confidence=F.lit(0.95), reason="registry")


def osm_evidence(df: DataFrame) -> DataFrame:
    """Map objects: exact with 0.85 where dated, else presence with 0.6."""
    dated = F.col("sd").isNotNull()
    return _evidence(df, F.when(dated, "exact").otherwise("presence"), exact=F.col("sd"), confidence=F.when(dated, 0.85).otherwise(0.6), reason="map object")


def map_evidence(df: DataFrame) -> DataFrame:
    """Detections on a dated map: there by the map's year, with their own confidence or 0.75."""
    return _evidence(df, "presence", max_year=F.col("map_year"), confidence=F.coalesce("confidence", F.lit(0.75)), reason="detection")


def _evidence(df: DataFrame, kind, *, exact: Column | None = None, max_year: Column | None = None, confidence: Column, reason: str) -> DataFrame:
    none = F.lit(None).cast("int")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    ends = F.col("ed") if "ed" in df.columns else none
    return df.select("building_id", "source_id", kind.alias("evidence_type"), none.alias("min_year"), (none if max_year is None else max_year).alias("max_year"), (none if exact is None else exact).alias("exact_year"), ends.alias("end_year"), confidence.alias("confidence"), F.lit(reason).alias("confidence_reason"))


def best_estimate(ev: DataFrame, sources: DataFrame, this_year: int) -> DataFrame:
    """One estimate a building.

    The exact year of confidence 0.7 or more from the source of the smallest priority decides.
    Else bounds are intersected: presence before 2020 from above, absence from below, ranges from
    both, weak exact years within ten years; bounds that cross give their middle within 20 years.
    Narrow ranges and more evidence raise the confidence; without a bound the method is `unknown`.
    Ties of priority fall to the smaller source id, then to the smaller year, the higher confidence,
    and the smaller end, none before any.
    """
    rows = ev.join(sources.select("source_id", "priority"), "source_id", "left").withColumn("priority", F.coalesce("priority", F.lit(999)))
    kind = F.col("evidence_type")
    sure = (kind == "exact") & (F.coalesce("exact_year", F.lit(0)) != 0) & (F.col("confidence") >= 0.7)
    weak = (kind == "exact") & (F.coalesce("exact_year", F.lit(0)) != 0) & ~sure
    present = (kind == "presence") & (F.col("max_year") < MODERN)
    low = F.when(kind.isin("absence", "range"), F.col("min_year")).when(weak, F.col("exact_year") - WEAK)
    high = F.when(present | (kind == "range"), F.col("max_year")).when(weak, F.col("exact_year") + WEAK)
    order = F.struct("priority", "source_id", "exact_year", -F.col("confidence"), "end_year")
    agg = rows.groupBy("building_id").agg(
        F.min_by(F.struct("exact_year", "end_year", "confidence", "source_id"), F.when(sure, order)).alias("exact"),
        F.max(low).alias("low"),
        F.min(high).alias("high"),
        F.min("end_year").alias("end_year"),
        F.count("*").alias("evidence_count"),
        F.array_sort(F.collect_set("source_id")).alias("sources"),
        F.min_by("source_id", F.struct("priority", "source_id")).alias("first_source"),
    )
    a, b = F.greatest(F.coalesce("low", F.lit(EARLIEST)), F.lit(EARLIEST)), F.least(F.coalesce("high", F.lit(this_year)), F.lit(this_year))
    agg = agg.withColumn("a", a).withColumn("b", b).withColumn("mid", F.floor((F.col("a") + F.col("b")) / 2).cast("int"))
    crossed = F.col("crossed")
    agg = agg.withColumn("crossed", F.col("a") > F.col("b")).withColumn("a", F.when(crossed, F.col("mid") - CONTRADICTION).otherwise(F.col("a"))).withColumn("b", F.when(crossed, F.col("mid") + CONTRADICTION).otherwise(F.col("b")))
    width = F.col("b") - F.col("a")
    confidence, method = F.lit(None).cast("double"), F.lit(None).cast("string")
    for most, c, m in reversed(WIDTHS):
        confidence = F.lit(c) if most is None else F.when(width <= most, c).otherwise(confidence)
        method = F.lit(m) if most is None else F.when(width <= most, m).otherwise(method)
    confidence = F.round(F.least(F.lit(0.95), confidence + F.least(F.lit(0.1), F.col("evidence_count") * 0.02)), 3)
    has_exact, bounded = F.col("exact").isNotNull(), F.col("low").isNotNull() | F.col("high").isNotNull()
    pick = lambda exact, other, none: F.when(has_exact, exact).when(bounded, other).otherwise(none)
    null = F.lit(None).cast("int")
    return agg.select(
        "building_id",
        pick(F.col("exact.exact_year"), F.col("mid"), null).alias("start_year"),
        pick(F.col("exact.exact_year"), F.col("a"), null).alias("start_year_min"),
        pick(F.col("exact.exact_year"), F.col("b"), null).alias("start_year_max"),
        pick(F.col("exact.end_year"), F.col("end_year"), null).alias("end_year"),
        pick(F.col("exact.confidence"), confidence, F.lit(0.0)).alias("confidence"),
        pick(F.lit("exact"), method, F.lit("unknown")).alias("method"),
        F.when(has_exact, F.array("exact.source_id")).otherwise(F.col("sources")).alias("contributing_sources"),
        F.when(has_exact, F.col("exact.source_id")).otherwise(F.col("first_source")).alias("primary_source"),
        "evidence_count",
    )


def match_confidence(overlap: Column, distance: Column) -> Column:
    """How sure a match of two buildings is."""
    return F.when(overlap >= 0.7, 0.9).when(overlap >= 0.5, 0.8).when((overlap >= 0.3) | (distance < 5), 0.7).when(distance < 10, 0.6).otherwise(0.5)


def propagate(ev: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence that matched buildings (a, b, confidence) lend each other, for sources that the receiver lacks: one simultaneous hop.

    Of several offers from one source the surest counts, ties by the giver's id.
    """
    both = links.select(F.col("a").alias("giver"), F.col("b").alias("taker"), F.col("confidence").alias("sure")).union(links.select("b", "a", "confidence"))
    offers = ev.withColumnRenamed("building_id", "giver").join(both, "giver").withColumn("confidence", F.col("confidence") * F.col("sure"))
    offers = offers.join(ev.select(F.col("building_id").alias("taker"), "source_id").distinct(), ["taker", "source_id"], "left_anti")
    best = offers.groupBy("taker", "source_id").agg(F.max_by(F.struct("*"), F.struct("confidence", -F.col("giver"))).alias("o"))
    return best.select(F.col("taker").alias("building_id"), "source_id", F.col("o.evidence_type").alias("evidence_type"), F.col("o.min_year").alias("min_year"), F.col("o.max_year").alias("max_year"), F.col("o.exact_year").alias("exact_year"), F.col("o.end_year").alias("end_year"), F.col("o.confidence").alias("confidence"), F.col("o.giver").alias("giver"))


def estimate_by_centre(distance_km: Column) -> Column:
    """struct(year, confidence) by the distance to the town's centre."""
    out = None
    for most, year, sure in reversed(CENTRE_BANDS):
        value = F.struct(F.lit(year).alias("year"), F.lit(sure).alias("confidence"))
        out = value if most is None else F.when(distance_km < most, value).otherwise(out)
    return out


def combine_estimates(estimates: Column, default: int = 1950, sure: float = 0.15) -> Column:
    """struct(year, confidence, method) of an array of (year, confidence, method): years weighted by confidence."""
    known = F.filter(estimates, lambda e: e["year"].isNotNull() & (e["confidence"] > 0))
    weight = F.aggregate(known, F.lit(0.0), lambda t, e: t + e["confidence"])
    year = F.aggregate(known, F.lit(0.0), lambda t, e: t + e["year"] * e["confidence"]) / weight
    return F.when(
        F.size(known) > 0,
        F.struct(F.floor(year).cast("int").alias("year"), F.least(F.lit(0.95), F.array_max(F.transform(known, lambda e: e["confidence"]))).alias("confidence"), F.array_join(F.array_sort(F.transform(known, lambda e: e["method"])), "+").alias("method")),
    ).otherwise(F.struct(F.lit(default).alias("year"), F.lit(sure).alias("confidence"), F.lit("default").alias("method")))


def resolve_bounds(df: DataFrame) -> DataFrame:
    """Per id of bound rows (id, kind, year), kinds x exact, n not later than, e not earlier than: exact, else the middle, else one bound (e plus ten), else 1950."""
    of = lambda k, f: f(F.when(F.col("kind") == k, F.col("year")))
    agg = df.groupBy("id").agg(of("x", F.min).alias("x"), of("n", F.min).alias("n"), of("e", F.max).alias("e"))
    return agg.select("id", F.coalesce("x", F.floor((F.col("n") + F.col("e")) / 2).cast("int"), "n", F.col("e") + 10, F.lit(1950)).alias("sd"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new snapshot: rows of `new` replace those of `old` with their key."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A new snapshot where new values that are there replace old ones, but for the columns in `keep`."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep else F.coalesce(f"b.{c}", f"a.{c}")
    columns = [c for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[(pick(c) if c in new.columns else F.col(f"a.{c}")).alias(c) for c in columns])


def apply_estimates(buildings: DataFrame, estimates: DataFrame) -> DataFrame:
    """Buildings with est_start_year, est_confidence and est_method, kept where no estimate is new."""
    e = estimates.select("building_id", F.col("start_year").alias("_y"), F.col("confidence").alias("_c"), F.col("method").alias("_m"))
    out = buildings.join(e, "building_id", "left")
    for own, new, kind in (("est_start_year", "_y", "int"), ("est_confidence", "_c", "double"), ("est_method", "_m", "string")):
        old = F.col(own) if own in buildings.columns else F.lit(None).cast(kind)
        out = out.withColumn(own, F.coalesce(F.col(new), old))
    return out.drop("_y", "_c", "_m")


#: Words of a building's type, area in square metres from which it is large, year and confidence if it is, and if it isn't.
TYPES = (
    (("industrial", "warehouse", "factory", "commercial"), 500, (1950, 0.4), (1920, 0.3)),
    (("church", "cathedral", "chapel"), 0, (1800, 0.25), (1800, 0.25)),
    (("garage", "parking", "supermarket", "mall"), 0, (1970, 0.5), (1970, 0.5)),
    (("apartment", "residential"), 1000, (1960, 0.35), (None, 0.0)),
)


def estimate_by_type(kind: Column, area: Column) -> Column:
    """struct(year, confidence) by a building's type and size; year null and confidence 0 where they say nothing."""
    pair = lambda y, c: F.struct(F.lit(y).cast("int").alias("year"), F.lit(float(c)).alias("confidence"))
    out = None
    for words, size, large, small in TYPES:
        fits = F.lower(kind).rlike("|".join(words))
        value = F.when(area > size, pair(*large)).otherwise(pair(*small))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(pair(None, 0.0))


def estimate_by_neighbours(asked: DataFrame, donors: DataFrame, radius: float = 300.0, least: float = 1.0, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(id, year, confidence, neighbours) of rows (id, x, y) from donors (id, x, y, year, confidence) within the radius and farther than `least`.

    Years weigh by confidence and by nearness, falling to 0 at the radius; the confidence is half
    the mean weight, 0.6 at most. Rows without a weight have no estimate.
    """
    from . import spatial

    pairs = spatial.within_distance(asked.select("id", "x", "y"), donors.select("id", "x", "y", "year", "confidence"), radius, scale).where(F.col("distance") > least)
    pairs = pairs.select(F.col("a.id").alias("id"), F.col("b.year").alias("year"), (F.col("b.confidence") * (1 - F.col("distance") / radius)).alias("weight"))
    sums = pairs.groupBy("id").agg(F.sum("weight").alias("w"), F.sum(F.col("year") * F.col("weight")).alias("wy"), F.count("*").alias("neighbours")).where("w > 0")
    return sums.select("id", F.round(F.col("wy") / F.col("w"), 6).cast("int").alias("year"), F.least(F.lit(0.6), F.col("w") / F.col("neighbours") * 0.5).alias("confidence"), "neighbours")


def extraction_confidence(model: Column, area: Column, shape: Column, context: Column) -> Column:
    """How sure a feature read off a map is: the model's probability, and how fit its size, shape and surroundings are."""
    return 0.4 * model + 0.2 * area + 0.2 * shape + 0.2 * context


def recompute(buildings: DataFrame, ev: DataFrame, sources: DataFrame, this_year: int, matched: DataFrame | None = None) -> DataFrame:
    """Buildings with estimates made anew, of all or only of those in `matched` (building_id); others keep what they have."""
    if matched is not None:
        ev = ev.join(matched.select("building_id").distinct(), "building_id", "left_semi")
    return apply_estimates(buildings, best_estimate(ev, sources, this_year))


def with_priority(ev: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with its source's name and priority; evidence of unknown sources is left out."""
    return ev.join(sources.select("source_id", "source_name", "priority"), "source_id")
