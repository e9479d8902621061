"""Column kinds and safe column references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC, TEXT, BOOLEAN, DATETIME, OTHER = "numeric", "text", "boolean", "datetime", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    """Column name to kind, in schema order."""
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in wanted]


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
