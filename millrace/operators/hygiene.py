"""The second scanner: looser thresholds, aimed at the option-driven cleaner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import number_text, percent
from millrace.operators.facts import TableFacts
from millrace.operators.quality import banded
from millrace.schema import TEXT

# Thresholds of the scanner, in percent unless named otherwise.
MISSING_HIGH, MISSING_MEDIUM = 30, 10
DUPLICATES_HIGH_SHARE = 0.05
NUMERIC_SHARE, DATE_SHARE = 0.85, 0.80
DROP_MISSING = 50
MESSY_NAME = r"[^\p{L}\p{N}_]|^_*$"


def _issues(found: DataFrame, check_no: int, issue_type: str, severity: Column, count=None, pct=None, named=True) -> DataFrame:
    return found.select(
        F.lit(check_no).alias("check_no"),
        (F.col("position") if named else F.lit(-1)).alias("position"),
        F.lit(issue_type).alias("type"),
        (F.col("column") if named else F.lit(None).cast("string")).alias("column"),
        severity.alias("severity"),
        (F.lit(None) if count is None else count).cast("bigint").alias("count"),
        (F.lit(None) if pct is None else pct).cast("double").alias("percentage"),
    )


def missing_values(facts: TableFacts) -> DataFrame:
    found = facts.frame().where("nulls > 0").withColumn("pct", percent(F.col("nulls"), F.col("rows"), 1))
    pct = F.col("pct")
    severity = banded(pct, (pct > MISSING_HIGH, "high"), (pct > MISSING_MEDIUM, "medium"), otherwise="low")
    return _issues(found, 1, "missing_values", severity, F.col("nulls"), pct)


def duplicates(facts: TableFacts) -> DataFrame:
    found = facts.frame("duplicates").where("position = 0 and duplicates > 0")
    severity = F.when(F.col("duplicates") > F.col("rows") * DUPLICATES_HIGH_SHARE, "high").otherwise("medium")
    pct = percent(F.col("duplicates"), F.col("rows"), 1)
    return _issues(found, 2, "duplicate_rows", severity, F.col("duplicates"), pct, named=False)


def whitespace(facts: TableFacts) -> DataFrame:
    return _issues(facts.frame("text_shares").where("padded"), 3, "whitespace", F.lit("low"))


def looks_numeric(facts: TableFacts) -> DataFrame:
    found = facts.frame("text_shares").where((F.col("kind") == TEXT) & (F.col("numbers") > F.col("filled") * NUMERIC_SHARE))
    return _issues(found, 4, "wrong_dtype_numeric", F.lit("medium"))


def looks_like_date(facts: TableFacts) -> DataFrame:
    """Judged on the whole column: the first rows of a distributed table are not defined."""
    found = facts.frame("text_shares").where((F.col("kind") == TEXT) & (F.col("dates") > F.col("filled") * DATE_SHARE))
    return _issues(found, 5, "wrong_dtype_datetime", F.lit("low"))


def constant_or_empty(facts: TableFacts) -> DataFrame:
    return _issues(facts.frame("constants").where("constant or filled = 0"), 6, "constant_column", F.lit("low"))


def all_null(facts: TableFacts) -> DataFrame:
    found = facts.frame().where("filled = 0")
    return _issues(found, 7, "all_null_column", F.lit("high"), F.col("rows"), F.lit(100.0))


def messy_names(facts: TableFacts) -> DataFrame:
    found = (
        facts.frame()
        .where(F.col("column").rlike(MESSY_NAME))
        .agg(F.count("*").alias("n"))
        .where("n > 0")
    )
    return _issues(found, 8, "messy_column_names", F.lit("low"), F.col("n"), named=False)


CHECKS = (
    missing_values, duplicates, whitespace, looks_numeric, looks_like_date, constant_or_empty, all_null, messy_names,
)


def cleaning_report(facts: TableFacts) -> DataFrame:
    """All findings with a suggestion each, in check and column order."""
    facts.gather("duplicates", "text_shares", "constants")
    found = reduce(DataFrame.unionByName, [check(facts) for check in CHECKS])
    return found.withColumn("suggestion", suggestion()).orderBy("check_no", "position")


def suggestion() -> Column:
    """What to do about a finding, with its figures."""
    column, kind = F.col("column"), F.col("type")
    share = number_text(F.col("percentage"), 1)
    told = {
        "duplicate_rows": F.concat(F.lit("keep one of each repeated row: "), F.col("count"), F.lit(" go")),
        "whitespace": F.concat(column, F.lit(": trim blanks at the ends")),
        "wrong_dtype_numeric": F.concat(column, F.lit(": numbers held as text, make them numbers")),
        "wrong_dtype_datetime": F.concat(column, F.lit(": dates held as text, make them times")),
        "constant_column": F.concat(column, F.lit(": the same in every row, leave it out")),
        "all_null_column": F.concat(column, F.lit(": empty, leave it out")),
        "messy_column_names": F.lit("names: lower case and underscores only"),
    }
    mostly_empty = F.concat(column, F.lit(": "), share, F.lit("% of the cells are empty, leave it out"))
    some_empty = F.concat(column, F.lit(": "), share, F.lit("% of the cells are empty, give them a value"))
    text = F.when(kind == "missing_values", F.when(F.col("percentage") > DROP_MISSING, mostly_empty).otherwise(some_empty))
    for finding, sentence in told.items():
        text = text.when(kind == finding, sentence)
    return text


def verdict(report: DataFrame) -> DataFrame:
    """One row: issue count and major / minor / clean."""
    return report.agg(
        F.count("*").alias("issue_count"),
        F.when(F.count_if(F.col("severity") == "high") > 0, "major")
        .when(F.count("*") > 0, "minor")
        .otherwise("clean")
        .alias("verdict"),
    )


# Cleaner option and the finding that switches it on.
OPTION_FOR_FINDING = {
    "drop_duplicates": "duplicate_rows",
    "fill_missing_numeric": "missing_values",
    "fill_missing_categorical": "missing_values",
    "strip_whitespace": "whitespace",
    "convert_numeric": "wrong_dtype_numeric",
    "parse_dates": "wrong_dtype_datetime",
    "drop_constant_cols": "constant_column",
    "drop_all_null_cols": "all_null_column",
    "standardise_col_names": "messy_column_names",
}


def suggested_options(report: DataFrame) -> DataFrame:
    """One row with a boolean per option of the cleaner."""
    def seen(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    flags = [seen(F.col("type") == finding).alias(option) for option, finding in OPTION_FOR_FINDING.items()]
    too_empty = (F.col("type") == "missing_values") & (F.col("percentage") > DROP_MISSING)
    return report.agg(*flags, seen(too_empty).alias("drop_high_missing"))


