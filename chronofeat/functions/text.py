"""Names, source codes and evidence levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short codes of sources, id prefixes, and the order of evidence levels.
SOURCE_CODES = {"sefrak": "sef", "trondheim_kommune": "tk", "matrikkelen": "mat", "osm": "osm", "manual": "man", "finn": "finn", "fkb_bygning": "fkb"}
ID_PREFIXES = ("SEFRAK-", "way/", "relation/", "node/", "ml-")
EVIDENCE_ORDER = {"h": 3, "m": 2, "l": 1}


def map_literal(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def source_code(source: Column) -> Column:
    """`sefrak` to `sef` and so on; detected sources are `ml`; others stay."""
    return F.when(source.startswith("ml_"), "ml").otherwise(F.coalesce(F.element_at(map_literal(SOURCE_CODES), source), source))


def ml_source_code(source: Column) -> Column:
    """Kind and year of a detected source: maps of the mapping authority kv, aerial photographs air, others map; null without a year."""
    year = F.nullif(F.regexp_extract(source, r"(\d{4})", 1), F.lit(""))
    kind = F.when(source.contains("kartverket"), "kv").when(source.contains("aerial"), "air").otherwise("map")
    return F.when(source.startswith("ml_"), F.concat(kind, year))


def feature_code(source: Column, source_id: Column) -> Column:
    """A short feature id: the source's code and its id without prefix."""
    rest = F.regexp_replace(source_id, "^(" + "|".join(ID_PREFIXES) + ")", "")
    return F.concat(source_code(source), F.lit("-"), rest)


def road_code(source_id: Column) -> Column:
    """The last part of a road id that `/` or `-` separate."""
    return F.element_at(F.split(source_id, "[/-]"), -1)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.7 if one holds the other, 0.3 for three equal first letters, else 0; 0 if one is missing."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    score = F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.7).when((F.char_length(a) >= 3) & (F.char_length(b) >= 3) & (F.left(a, F.lit(3)) == F.left(b, F.lit(3))), 0.3).otherwise(0.0)
    return F.when((F.char_length(a) > 0) & (F.char_length(b) > 0), score).otherwise(0.0)


def evidence_rank(ev: Column) -> Column:
    """h 3, m 2, l 1, others 0."""
    return F.coalesce(F.element_at(map_literal(EVIDENCE_ORDER), ev), F.lit(0))


def evidence_of_rank(rank: Column) -> Column:
    return F.when(rank == 3, "h").when(rank == 2, "m").when(rank == 1, "l")


def meets(ev: Column, least: Column | str) -> Column:
    """Whether evidence reaches a level."""
    return evidence_rank(ev) >= evidence_rank(F.lit(least) if isinstance(least, str) else least)


def stronger(a: Column, b: Column) -> Column:
    """The stronger of two levels; the first if they are alike."""
    return F.when(evidence_rank(b) > evidence_rank(a), b).otherwise(a)


def evidence_from_confidence(confidence: Column, high: float = 0.9, middle: float = 0.7) -> Column:
    return F.when(confidence >= high, "h").when(confidence >= middle, "m").otherwise("l")


def rule_min_evidence(rule: str) -> str:
    """The level that a rule's text asks for: `>= high`, `>= medium`; any evidence else."""
    rule = rule.lower()
    return "h" if "high" in rule else "m" if "medium" in rule else "l"


def without_nulls(tags: Column) -> Column:
    return F.map_filter(tags, lambda _, v: v.isNotNull())


def subset(tags: Column, keys: tuple[str, ...]) -> Column:
    """A map's entries of the given keys."""
    return F.map_filter(tags, lambda k, v: k.isin(*keys) & v.isNotNull())


def first_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    """The first value among the keys."""
    return F.coalesce(*[F.element_at(tags, k) for k in keys])
