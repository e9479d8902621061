"""Quality checks: findings as rows, one table for all checks.

Every check reads the column facts (one row per column) and returns rows of
``ISSUE_COLUMNS``. ``quality_report`` is their union in report order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import number_text, percent
from millrace.operators.facts import TableFacts
from millrace.schema import NUMERIC, TEXT

ISSUE_COLUMNS = [
    "check_no", "position", "type", "column", "severity", "count", "pct", "target", "details", "recommendation",
]

# Thresholds of the checks, in percent unless named otherwise.
MISSING_CRITICAL, MISSING_HIGH, MISSING_MEDIUM = 50, 20, 5
DUPLICATES_HIGH, DUPLICATES_MEDIUM = 10, 1
MANY_DISTINCT, MANY_DISTINCT_PCT = 100, 50
OUTLIERS_HIGH, OUTLIERS_MEDIUM = 10, 5
MISTYPED_SHARE = 0.80
EMAIL_NAME_PARTS = ("email", "e_mail", "mail", "correo")
EMAIL_COLUMN_SHARE, EMAILS_BAD, EMAILS_BAD_HIGH = 0.20, 5, 25
SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 3 for low; unknown severities sort last."""
    position = F.array_position(F.lit(list(SEVERITIES)), severity)
    return F.when(position > 0, position - 1).otherwise(99).cast("int")


def banded(value: Column, *bands: tuple[Column | bool, str], otherwise: str) -> Column:
    """The label of the first band whose condition holds."""
    expression = F
    for condition, label in bands:
        expression = expression.when(condition, F.lit(label))
    return expression.otherwise(F.lit(otherwise))


def _issues(
    found: DataFrame, check_no: int, issue_type: str, severity: Column, count: Column, pct: Column, details: Column,
    recommendation: Column, column: Column | None = None, target: Column | None = None,
) -> DataFrame:
    return found.select(
        F.lit(check_no).alias("check_no"),
        (F.col("position") if column is None else F.lit(-1)).alias("position"),
        F.lit(issue_type).alias("type"),
        (F.col("column") if column is None else column).alias("column"),
        severity.alias("severity"),
        count.cast("bigint").alias("count"),
        pct.cast("double").alias("pct"),
        (F.lit(None).cast("string") if target is None else target).alias("target"),
        details.alias("details"),
        recommendation.alias("recommendation"),
    )


def missing_values(facts: TableFacts) -> DataFrame:
    found = facts.frame().where("nulls > 0").withColumn("pct", percent(F.col("nulls"), F.col("rows")))
    pct = F.col("pct")
    severity = banded(
        pct,
        (pct >= MISSING_CRITICAL, "critical"),
        (pct >= MISSING_HIGH, "high"),
        (pct >= MISSING_MEDIUM, "medium"),
        otherwise="low",
    )
    advice = banded(
        pct,
        (pct >= MISSING_CRITICAL, "drop the column"),
        (F.col("kind") == NUMERIC, "fill with the median"),
        otherwise="fill with the mode",
    )
    details = F.concat(F.col("nulls"), F.lit(" missing values ("), number_text(pct), F.lit("%)"))
    return _issues(found, 1, "missing_values", severity, F.col("nulls"), pct, details, advice)


def duplicates(facts: TableFacts) -> DataFrame:
    found = (
        facts.frame("duplicates")
        .where("position = 0 and duplicates > 0")
        .withColumn("pct", percent(F.col("duplicates"), F.col("rows")))
    )
    pct = F.col("pct")
    severity = banded(pct, (pct > DUPLICATES_HIGH, "high"), (pct > DUPLICATES_MEDIUM, "medium"), otherwise="low")
    details = F.concat(F.col("duplicates"), F.lit(" duplicate rows ("), number_text(pct), F.lit("%)"))
    return _issues(
        found, 2, "duplicate_rows", severity, F.col("duplicates"), pct, details,
        F.lit("drop the repeated rows"), column=F.lit(None).cast("string"),
    )


def high_cardinality(facts: TableFacts) -> DataFrame:
    found = (
        facts.frame("text_distinct")
        .where(F.col("kind") == TEXT)
        .withColumn("pct", percent(F.col("distinct"), F.col("rows")))
        .where((F.col("distinct") > MANY_DISTINCT) | (F.col("pct") > MANY_DISTINCT_PCT))
    )
    details = F.concat(F.col("distinct"), F.lit(" unique values ("), number_text(F.col("pct")), F.lit("% of rows)"))
    return _issues(
        found, 3, "high_cardinality", F.lit("medium"), F.col("distinct"), F.col("pct"), details,
        F.lit("encode, bin or drop the column"),
    )


def outliers(facts: TableFacts) -> DataFrame:
    found = (
        facts.frame("outliers")
        .where("outliers > 0")
        .withColumn("pct", percent(F.col("outliers"), F.col("filled")))
    )
    pct = F.col("pct")
    severity = banded(pct, (pct > OUTLIERS_HIGH, "high"), (pct > OUTLIERS_MEDIUM, "medium"), otherwise="low")
    limits = [number_text(F.round(F.col(edge), 2)) for edge in ("fence_low", "fence_high")]
    details = F.concat(
        F.col("outliers"), F.lit(" outliers ("), number_text(pct), F.lit("%) outside IQR ["),
        limits[0], F.lit(", "), limits[1], F.lit("]"),
    )
    return _issues(
        found, 4, "outliers", severity, F.col("outliers"), pct, details, F.lit("inspect or clip the values")
    )


def type_mismatches(facts: TableFacts) -> DataFrame:
    """Text columns that read as numbers or, failing that, as dates.

    A cheap look at the first rows before trying dates is not needed here: text that
    parses in one of the layouts always has digits and separators.
    """
    share = {kind: F.try_divide(F.col(kind), F.col("filled")) for kind in ("numbers", "dates")}
    found = (
        facts.frame("text_shares")
        .where((F.col("kind") == TEXT) & (F.col("filled") > 0))
        .withColumn(
            "target",
            F.when(share["numbers"] >= MISTYPED_SHARE, "numeric").when(share["dates"] >= MISTYPED_SHARE, "datetime"),
        )
        .where("target is not null")
        .withColumn("parsed", F.when(F.col("target") == "numeric", F.col("numbers")).otherwise(F.col("dates")))
        .withColumn("pct", percent(F.col("parsed"), F.col("filled"), 1))
    )
    details = F.concat(
        F.lit("Column is text but "), number_text(F.col("pct"), 1), F.lit("% values are "), F.col("target")
    )
    return _issues(
        found, 5, "type_mismatch", F.lit("medium"), F.col("parsed"), F.col("pct"), details,
        F.concat(F.lit("cast the column to "), F.col("target")), target=F.col("target"),
    )


def constant_columns(facts: TableFacts) -> DataFrame:
    found = facts.frame("constants").where("constant")
    severity = F.when(F.col("nulls") > 0, "medium").otherwise("high")
    details = F.concat(F.lit("only 1 unique value: '"), F.col("constant_value"), F.lit("'"))
    return _issues(
        found, 6, "constant_column", severity, F.lit(1), F.lit(None), details, F.lit("drop the constant column")
    )


def invalid_emails(facts: TableFacts) -> DataFrame:
    named = F.lit(False)
    for part in EMAIL_NAME_PARTS:
        named = named | F.lower("column").contains(part)
    found = (
        facts.frame("text_shares")
        .where((F.col("kind") == TEXT) & (F.col("filled") > 0))
        .where(named | (F.try_divide(F.col("at_signs"), F.col("filled")) >= EMAIL_COLUMN_SHARE))
        .withColumn("invalid", F.col("filled") - F.col("emails"))
        .withColumn("pct", percent(F.col("invalid"), F.col("filled")))
        .where(F.col("pct") > EMAILS_BAD)
    )
    severity = F.when(F.col("pct") > EMAILS_BAD_HIGH, "high").otherwise("medium")
    details = F.concat(
        F.col("invalid"), F.lit(" invalid email addresses ("), number_text(F.col("pct")), F.lit("% of non-null values)")
    )
    return _issues(
        found, 7, "invalid_emails", severity, F.col("invalid"), F.col("pct"), details,
        F.lit("validate the addresses"),
    )


#: The checks in report order, and the passes over the table each of them needs.
PASSES: dict[Callable[[TableFacts], DataFrame], tuple[str, ...]] = {
    missing_values: (),
    duplicates: ("duplicates",),
    high_cardinality: ("text_distinct",),
    outliers: ("outliers",),
    type_mismatches: ("text_shares",),
    constant_columns: ("constants",),
    invalid_emails: ("text_shares",),
}
CHECKS = tuple(PASSES)


def quality_issues(facts: TableFacts, checks: Sequence[Callable[[TableFacts], DataFrame]] = CHECKS) -> DataFrame:
    """The findings of the checks (all by default), unordered."""
    facts.gather(*[needed for check in checks for needed in PASSES[check]])
    return reduce(DataFrame.unionByName, [check(facts) for check in checks])


def quality_report(facts: TableFacts) -> DataFrame:
    """All findings, most severe first, then in check and column order."""
    return quality_issues(facts).orderBy(severity_rank(F.col("severity")), "check_no", "position")
