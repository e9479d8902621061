"""Reading numbers and dates out of text. Everything that does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted number shape and date layouts.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
ISO_LAYOUT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
OFFSET_LAYOUT = r"^\s*\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})\s*$"
#: Day and month, in either order, and year, with one of three separators; what may follow.
EITHER_ORDER = r"^\d{1,2}([-/.])\d{1,2}\1\d{4}"
TIMES = {"$": "", r" \d{1,2}:\d{2}$": " H:mm", r" \d{1,2}:\d{2}:\d{2}$": " H:mm:ss"}
YEAR_FIRST_LAYOUTS = {
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$": "yyyy/M/d H:mm",
    r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$": "yyyy/M/d H:mm:ss",
}
NAMED_LAYOUT, NAMED = r"(?i)^\d{1,2}-[a-z]{3}-\d{4}$", "d-MMM-yyyy"


def as_number(column: Column) -> Column:
    """Double, or null.

    The shape test comes first: it leaves out Java spellings that Spark's cast would
    take (``1.0f``, ``1d``) and the text ``nan``, and it spares the cast from raising
    and catching an error for each of the many values that are plain words.
    """
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def as_integer(column: Column) -> Column:
    return F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), column.try_cast("bigint"))


def _in_order(column: Column, order: str) -> Column:
    """Dates of two numbers and a year, as ``M/d`` or ``d/M``."""
    slashed = F.translate(column, "-.", "//")
    read = [
        F.when(column.rlike(EITHER_ORDER + shape), F.try_to_timestamp(slashed, F.lit(f"{order}/yyyy{layout}")).cast("timestamp_ntz"))
        for shape, layout in TIMES.items()
    ]
    return F.when(column.rlike(EITHER_ORDER), F.coalesce(*read))


def order_votes(column: Column) -> dict[str, Column]:
    """Aggregates ``only_day`` and ``only_month``: how many cells are dates only if the day, or the month, comes first.

    A column is read day first if the former are more; with none, or as many of either, month first.
    """
    day, month = _in_order(column, "d/M"), _in_order(column, "M/d")
    return {"only_day": F.count_if(day.isNotNull() & month.isNull()), "only_month": F.count_if(month.isNotNull() & day.isNull())}


def as_timestamp(column: Column, day_first: bool = False) -> Column:
    """Timestamp without zone, or null.

    Layouts: ISO date or time; ISO time with Z or an offset, read as the time in UTC; year/month/day; month and day, or
    with ``day_first`` day and month, and year, separated by slashes, dots or hyphens; these also with a time;
    day-month-year with an English short month name.
    """
    iso = F.when(column.rlike(ISO_LAYOUT), column.try_cast("timestamp_ntz"))
    slashes = [
        F.when(column.rlike(shape), F.try_to_timestamp(column, F.lit(layout)).cast("timestamp_ntz"))
        for shape, layout in YEAR_FIRST_LAYOUTS.items()
    ]
    with_seconds = F.regexp_replace(column, r"^(\s*\d+-\d+-\d+[T ]\d+:\d{2})(\s?[Z+-])", "$1:00$2")
    instant = F.when(column.rlike(OFFSET_LAYOUT), with_seconds.try_cast("timestamp"))
    zoned = F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")
    named = F.when(column.rlike(NAMED_LAYOUT), F.try_to_timestamp(F.initcap(F.lower(column)), F.lit(NAMED)).cast("timestamp_ntz"))
    either = _in_order(column, "d/M" if day_first else "M/d")
    return F.coalesce(iso, zoned, F.when(column.contains("/"), F.coalesce(*slashes)), either, named)
