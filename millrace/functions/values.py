"""Null, equality and percentage expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.schema import ref

#: Texts longer than this are compared by digest, so that shuffles carry 65 bytes instead of the text.
LONG_TEXT = 64


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN read as null: both count as missing."""
    column = ref(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(column, F.lit(None).cast(df.schema[name].dataType))
    return column


def is_missing(df: DataFrame, name: str) -> Column:
    column = ref(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def short_text(column: Column) -> Column:
    """The text itself, or a marked SHA-256 digest when it is long.

    The digest form is one character longer than any text kept as is, so the two
    never meet.
    """
    return F.when(F.length(column) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(column, 256))).otherwise(column)


def distinct_key(df: DataFrame, name: str) -> Column:
    """An expression that groups equal values together and is small to shuffle."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        return short_text(ref(name))
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return short_text(F.to_json(ref(name)))
    return present(df, name)


def text_key(df: DataFrame, name: str) -> Column:
    """``distinct_key`` as text, for tables that stack columns of different types."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return (present(df, name) + F.lit(0.0)).cast("string")
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return short_text(F.to_json(ref(name)))
    return distinct_key(df, name).cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row: equal for rows that hold the same values, missing ones (null or NaN) included.

    Values are told apart by their text in a JSON list, where null, the text "null" and the borders between
    columns cannot be mixed up.
    """
    cells = [
        F.hex(ref(field.name)) if isinstance(field.dataType, T.BinaryType) else text_key(df, field.name) for field in df.schema.fields
    ]
    return F.sha2(F.to_json(F.array(*cells)), 256) if cells else F.lit("")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null when one of them does not vary.

    The built-in ``corr`` divides by zero there, which is an error in ANSI mode. The
    determination coefficient is guarded, and the covariance gives the sign.
    """
    explained, direction = F.regr_r2(y, x), F.covar_pop(x, y)
    flat = (direction == 0) & (explained == 1)
    return F.when(~flat, F.signum(direction) * F.sqrt(explained))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``; 0 for an empty whole."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.coalesce(F.round(share, digits), F.lit(0.0))
