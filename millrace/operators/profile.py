"""Profiles: shape, missing cells, duplicates, numeric statistics, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import percent
from millrace.functions.values import short_text
from millrace.operators.facts import TableFacts, duplicate_rows
from millrace.schema import BOOLEAN, NUMERIC, TEXT, columns_of, ref

# Words that mark a column name as personal.
PERSONAL_WORDS = (
    "name", "email", "phone", "ssn", "social", "address", "password", "credit", "card", "zip", "location",
)


def shape(facts: TableFacts) -> DataFrame:
    """One row per column with its kind, and the table's size on each row."""
    counted = facts.frame()
    numeric = sum(1 for kind in facts.kinds.values() if kind == NUMERIC)
    categorical = sum(1 for kind in facts.kinds.values() if kind in (TEXT, BOOLEAN))
    return counted.select(
        "position", "column", "data_type", "kind", "rows", "columns",
        F.lit(numeric).alias("numeric_columns"), F.lit(categorical).alias("categorical_columns"),
    )


def missing(facts: TableFacts) -> DataFrame:
    return facts.frame().select(
        "position", "column", F.col("nulls").alias("null_count"),
        percent(F.col("nulls"), F.col("rows")).alias("null_percentage"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """One row: duplicate rows and their share. Lazy."""
    return duplicate_rows(df).select(
        "duplicates", percent(F.col("duplicates"), F.col("rows")).alias("percentage")
    )


def numeric_statistics(facts: TableFacts) -> DataFrame:
    """Moments and quartiles of the numeric columns that hold any value, at 4 decimals."""
    wanted = ["mean", "median", "std", "low", "high", "skewness", "kurtosis", "q1", "q3"]
    renamed = {"low": "min", "high": "max"}
    return (
        facts.frame("moments", "quartiles")
        .where((F.col("kind") == NUMERIC) & (F.col("filled") > 0))
        .select("column", *[F.round(name, 4).alias(renamed.get(name, name)) for name in wanted])
    )


def describe(facts: TableFacts) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column (exact, unlike ``summary``)."""
    return (
        facts.frame("moments", "quartiles")
        .where(F.col("kind") == NUMERIC)
        .select(
            "column", F.col("filled").alias("count"), "mean", "std", F.col("low").alias("min"),
            F.col("q1").alias("q25"), F.col("median").alias("q50"), F.col("q3").alias("q75"),
            F.col("high").alias("max"),
        )
    )


def value_counts(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each text column; ties go to the smaller value.

    Equal values are found by their short key, and one text travels for each distinct value
    of a task. The rank filter runs per task before its shuffle (top-k per group), so no
    task receives all values of a column.
    """
    columns = columns_of(df, TEXT) if columns is None else columns
    cells = [
        F.struct(
            F.lit(i).alias("position"), short_text(ref(name).cast("string")).alias("key"), ref(name).cast("string").alias("value")
        )
        for i, name in enumerate(columns)
    ]
    cells = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    by_frequency = Window.partitionBy("position").orderBy(F.desc("count"), "value")
    winners = (
        cells.groupBy("position", "key")
        .agg(F.count("*").alias("count"), F.min("value").alias("value"))
        .withColumn("rank", F.row_number().over(by_frequency))
        .where(F.col("rank") <= k)
    )
    names = F.element_at(F.array(*[F.lit(name) for name in columns]), F.col("position") + 1)
    return winners.select(names.alias("column"), "value", "count", "rank")


def completeness(facts: TableFacts) -> DataFrame:
    """One row: share of filled cells, with row, column and duplicate counts."""
    return (
        facts.frame("duplicates")
        .agg(
            F.max("rows").alias("total_rows"),
            F.max("columns").alias("total_columns"),
            F.max("duplicates").alias("duplicate_rows"),
            percent(F.sum("filled"), F.sum("rows")).alias("completeness_score"),
        )
    )


def schema_sheet(facts: TableFacts, examples: int = 5, few: int = 20) -> DataFrame:
    """Type and missing share per column, with example values for text columns of few values.

    Examples are the smallest values, so that the sheet does not depend on row order.
    """
    df = facts.df
    sheet = facts.frame("text_distinct").select(
        "position", "column", "data_type",
        F.round(F.col("nulls") * 100.0 / F.nullif(F.col("rows"), F.lit(0)), 1).alias("missing_pct"),
    )
    small = [name for name, n in facts.text_distinct.items() if n < few]
    if not small:
        return sheet.withColumn("examples", F.lit(None).cast("string"))
    cells = [F.struct(F.lit(name).alias("column"), ref(name).alias("value")) for name in small]
    values = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
    listed = values.groupBy("column").agg(
        F.array_join(F.slice(F.array_sort(F.collect_list("value")), 1, examples), ", ").alias("examples")
    )
    return sheet.join(F.broadcast(listed), "column", "left").select(*sheet.columns, "examples")


def personal_names(columns: list[str]) -> dict[str, str]:
    """Replacement for each column name that contains a personal word, numbered in order."""
    found = [c for c in columns if any(word in c.lower() for word in PERSONAL_WORDS)]
    return {name: f"[ANONYMIZED_PII_{i}]" for i, name in enumerate(found, 1)}


def mask_personal_names(df: DataFrame) -> DataFrame:
    """Hide personal column names; values are untouched."""
    return df.withColumnsRenamed(personal_names(df.columns))
