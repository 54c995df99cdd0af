"""Years from text: column expressions for the date notations of heritage records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The window of valid years, and years that period words stand for, in the order they are tried.
MIN_YEAR, MAX_YEAR, MIN_PREHISTORIC = 1700, 2030, -5000
PERIODS = (("middelalder", 1300), ("vikingtid", 900), ("jernald", 500), ("bronsealder", -1000), ("steinalder", -3000))

#: Notations of years.
RANGE = r"^(\d{4})\s*[-–]\s*(\d{4})$"
DECADE = r"^(\d{3})0s$"
PART_OF_DECADE = r"^(early|late|mid)\s+(\d{3})0s$"
CENTURY = r"^(\d{1,2})(?:st|nd|rd|th)\s+century"
HUNDREDS = r"^(\d{2})00-tallet$"
#: Pattern, group, factor and shift of notations that give one year, in the order they are tried.
SINGLE = (
    (r"^(\d{4})$", 1, 1, 0),
    (r"^[~c]a?\s*(\d{4})$", 1, 1, 0),
    (r"^(\d{4})-\d{1,2}", 1, 1, 0),
    (RANGE, 1, 1, 0),
    (DECADE, 1, 10, 0),
    (PART_OF_DECADE, 2, 10, 0),
    (CENTURY, 1, 100, -100),
    (HUNDREDS, 1, 100, 50),
)


def is_valid_year(year: Column, low: int = MIN_YEAR, high: int = MAX_YEAR) -> Column:
    """Whether a year lies in the window; null for null."""
    return year.between(low, high)


def within_window(year: Column, low: int = MIN_YEAR, high: int = MAX_YEAR) -> Column:
    """The year if it lies in the window, else null."""
    return F.when(year.between(low, high), year)


def _plain(value: Column) -> Column:
    return F.lower(F.btrim(value.cast("string"), F.lit(" \t\n\r\x0b\x0c")))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9999")).cast("int")


def parse_year(value: Column) -> Column:
    """One year of a text, by the first notation that fits; null if that year is outside the window, or none fits."""
    text = _plain(value)
    # a text that fits a notation is not tried by later ones, even if its year is not valid
    out = F.when(F.lit(False), F.lit(0))
    part = F.regexp_extract(text, PART_OF_DECADE, 1)
    into = F.when(part == "mid", 5).when(part == "late", 7).otherwise(0)
    for pattern, group, factor, shift in SINGLE:
        out = out.when(text.rlike(pattern), within_window(_group(text, pattern, group) * factor + shift + (into if pattern == PART_OF_DECADE else 0)))
    for word, year in PERIODS:
        out = out.when(text.contains(word), within_window(F.lit(year), MIN_PREHISTORIC))
    return out.otherwise(within_window(_group(text, r"\b(1[0-9]{3}|20[0-3][0-9])\b")))


def parse_year_range(value: Column) -> Column:
    """struct(start, end) of a text; a single year is both; each end is null outside the window."""
    text = _plain(value)
    ends = lambda a, b: F.struct(within_window(a).alias("start"), within_window(b).alias("end"))
    decade, part = _group(text, DECADE) * 10, F.regexp_extract(text, PART_OF_DECADE, 1)
    of = _group(text, PART_OF_DECADE, 2) * 10
    century, hundreds = (_group(text, CENTURY) - 1) * 100, _group(text, HUNDREDS) * 100
    year = parse_year(value)
    return (
        F.when(text.rlike(RANGE), ends(_group(text, RANGE, 1), _group(text, RANGE, 2)))
        .when(text.rlike(DECADE), ends(decade, decade + 9))
        .when(part == "early", ends(of, of + 20))
        .when(part == "mid", ends(of + 3, of + 7))
        .when(part == "late", ends(of + 7, of + 9))
        .when(text.rlike(CENTURY), ends(century, century + 99))
        .when(text.rlike(HUNDREDS), ends(hundreds, hundreds + 99))
        .otherwise(F.struct(year.alias("start"), year.alias("end")))
    )


def mid_year(start: Column, end: Column) -> Column:
    """The middle of two years rounded down, or the one that is there."""
    return F.coalesce(F.floor((start + end) / 2).cast("int"), start.cast("int"), end.cast("int"))


# ---------------------------------------------------------------- notations of single sources


def year_prefix(value: Column) -> Column:
    """The four digits that a tag value starts with."""
    return _group(F.trim(value), r"^(\d{4})")


def year_of_registry_date(value: Column) -> Column:
    """The year of `1950-01-01`, `01.01.1950` or `19500101`."""
    text = F.trim(value)
    return F.coalesce(_group(text, r"^(\d{4})-"), _group(text, r"\.(\d{4})$"), _group(text, r"^(\d{4})\d{0,4}$"))


def year_of_slashed_date(value: Column) -> Column:
    """The year of month/day/year, with or without a time."""
    return _group(F.trim(value), r"^\d{1,2}/\d{1,2}/(\d{4})")


def any_year(value: Column, low: int = 1700, high: int = 2100) -> Column:
    """The first four digits anywhere, if they lie in the window."""
    return within_window(_group(value.cast("string"), r"(\d{4})"), low, high)


def map_year(source: Column, low: int | None = None, high: int | None = None) -> Column:
    """The four digits in a source id, as of a map's year."""
    year = _group(source, r"(\d{4})")
    return year if low is None else within_window(year, low, high)


# ---------------------------------------------------------------- eras

#: Upper ends (exclusive) and names of eras.
ERAS = {
    3: ((1900, "pre_1900"), (1950, "1900_1950"), (None, "post_1950")),
    4: ((1850, "before 1850"), (1900, "1850-1899"), (1950, "1900-1949"), (None, "1950 on")),
    5: ((1850, "before 1850"), (1900, "1850-1899"), (1950, "1900-1949"), (1980, "1950-1979"), (None, "1980 on")),
    6: ((1800, "before 1800"), (1850, "1800-1849"), (1900, "1850-1899"), (1950, "1900-1949"), (2000, "1950-1999"), (None, "2000 on")),
    7: ((1750, "Early 18th Century"), (1800, "Late 18th Century"), (1850, "Early 19th Century"), (1900, "Late 19th Century"), (1950, "Early 20th Century"), (2000, "Late 20th Century"), (None, "21st Century")),
}
#: Names of the data behind a year, from it and up to it (exclusive).
DATA_SOURCES = ((None, 1900, "SEFRAK (Riksantikvaren)"), (1800, 1950, "Kartverket Historical"), (1950, None, "OpenStreetMap"))


def era(year: Column, bins: int = 3) -> Column:
    """The name of a year's era; null for null."""
    out = F.when(year.isNull(), F.lit(None).cast("string"))
    for end, name in ERAS[bins]:
        out = out.otherwise(name) if end is None else out.when(year < end, name)
    return out


def data_sources(year: Column) -> Column:
    """The names of the data that a year is shown from, joined by ` + `; empty for null."""
    names = []
    for low, high, name in DATA_SOURCES:
        within = F.lit(True) if low is None else year >= low
        names.append(F.when((within if high is None else within & (year < high)), name))
    return F.concat_ws(" + ", *names)
