"""Questions to one table: count, aggregate, group, filter, page, top-N, ad-hoc SQL.

Everything here is lazy and returns a DataFrame; Catalyst prunes the columns and
pushes the filters to the scan.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import is_missing, pearson, present
from millrace.operators.facts import TableFacts
from millrace.operators.profile import describe as describe_facts
from millrace.schema import NUMERIC, kind_of, ref, require

RESULT_CAP = 500
HEAD_DEFAULT, HEAD_MOST = 10, 100


@dataclass(frozen=True)
class QuerySpec:
    """One question. ``op`` is count, aggregate, group or filter."""

    op: str
    column: str | None = None
    function: str | None = None
    key: str | None = None
    comparison: str | None = None
    literal: object = None


def _aggregate(df: DataFrame, function: str, name: str) -> Column:
    value = present(df, name)
    if function in ("mean", "sum") and kind_of(df.schema[name].dataType) != NUMERIC:
        raise ValueError(f"{function} needs a numeric column, {name} is not")
    if function == "mean":
        return F.avg(value)
    if function == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if function == "min":
        return F.min(value)
    if function == "max":
        return F.max(value)
    raise ValueError(f"unknown aggregation: {function}")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def aggregate(df: DataFrame, function: str, column: str) -> DataFrame:
    """mean, sum (0 without values), min or max of a column."""
    require(df, column)
    return df.agg(_aggregate(df, function, column).alias(column))


def group_aggregate(df: DataFrame, function: str, column: str, key: str) -> DataFrame:
    """Aggregate per key; rows without a key are left out, output in key order."""
    require(df, column, key)
    return (
        df.where(~is_missing(df, key))
        .groupBy(ref(key))
        .agg(_aggregate(df, function, column).alias(column))
        .orderBy(ref(key))
    )


def filter_rows(df: DataFrame, column: str, comparison: str, literal) -> DataFrame:
    """Rows where the comparison holds. Missing values satisfy only ``!=``."""
    require(df, column)
    value = ref(column)
    conditions = {
        "=": value == literal, "==": value == literal,
        ">": value > literal, ">=": value >= literal, "<": value < literal, "<=": value <= literal,
    }
    if comparison == "!=":
        return df.where(~value.eqNullSafe(F.lit(literal)))
    if comparison not in conditions:
        raise ValueError(f"unsupported comparison: {comparison}")
    kept = df.where(conditions[comparison])
    # Spark ranks NaN above every number; a missing value must not pass.
    if comparison in (">", ">=") and isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        kept = kept.where(~F.isnan(value))
    return kept


def run(df: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.op == "count":
        return count(df)
    if spec.op == "aggregate":
        return aggregate(df, spec.function, spec.column)
    if spec.op == "group":
        return group_aggregate(df, spec.function, spec.column, spec.key)
    if spec.op == "filter":
        return filter_rows(df, spec.column, spec.comparison, spec.literal)
    raise ValueError(f"unknown operation: {spec.op}")


def head(df: DataFrame, order: list[str], n: int = HEAD_DEFAULT) -> DataFrame:
    """The first rows in the given order; a distributed table has no order of its own."""
    if n > HEAD_MOST:
        raise ValueError(f"at most {HEAD_MOST} rows; use page() for more")
    return df.orderBy(*[ref(c) for c in order]).limit(n)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in the given order."""
    return df.orderBy(*[ref(c) for c in order]).offset(number * size).limit(size)


def describe(df: DataFrame) -> DataFrame:
    return describe_facts(TableFacts(df))


def top_groups(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest sum; ties in key order."""
    require(df, column, key)
    return (
        df.where(~is_missing(df, key))
        .groupBy(ref(key))
        .agg(_aggregate(df, "sum", column).alias(column))
        .orderBy(F.desc(column), ref(key))
        .limit(n)
    )


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.agg(F.count_distinct(present(df, column)).alias("distinct"))


def correlation(df: DataFrame, first: str, second: str) -> DataFrame:
    """Pearson correlation over rows where both are present, at 6 decimals."""
    require(df, first, second)
    return df.agg(F.round(pearson(present(df, first).cast("double"), present(df, second).cast("double")), 6).alias("correlation"))


def sql(df: DataFrame, statement: str) -> DataFrame:
    """Ad-hoc analysis: SQL text over the table, named ``{dataset}`` in the statement."""
    return df.sparkSession.sql(statement, dataset=df)


def _readable(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(ref(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(data_type, T.DateType):
        return ref(name).cast("string")
    return present(df, name)


def capped(df: DataFrame, order: list[str] | None = None, cap: int = RESULT_CAP) -> DataFrame:
    """The rows an answer shows: at most ``cap``, NaN as null, times as ISO text."""
    ordered = df.orderBy(*[ref(c) for c in order]) if order else df
    return ordered.limit(cap).select(*[_readable(df, c).alias(c) for c in df.columns])


def truncation(df: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """One row: whether the answer was cut, and from how many rows."""
    return df.agg(
        (F.count("*") > cap).alias("truncated"),
        F.count("*").alias("total_rows"),
        F.least(F.count("*"), F.lit(cap)).cast("bigint").alias("returned_rows"),
    )


def literal_of(text: str):
    """Read a filter literal: integer, decimal, ISO date, or the text as written."""
    for read in (int, float, datetime.date.fromisoformat):
        try:
            return read(text)
        except ValueError:
            continue
    return text
