"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The address shape user@domain.tld, and the characters that count as blank.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Remove every kind of blank from both ends (``trim`` alone removes spaces)."""
    return F.btrim(column, F.lit(BLANKS))


def is_email(column: Column) -> Column:
    return column.contains("@") & column.rlike(EMAIL_PATTERN)


def number_text(column: Column, digits: int = 2) -> Column:
    """A number with up to ``digits`` decimals, at least one; in exponent form only beyond 36 digits."""
    fixed = F.regexp_replace(column.try_cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.coalesce(fixed, column.cast("string"))
