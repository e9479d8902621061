"""From findings to recommended cleaning actions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import number_text
from millrace.operators.facts import TableFacts
from millrace.operators.quality import CHECKS, PASSES, missing_values, quality_issues, severity_rank
from millrace.schema import NUMERIC

# Decision thresholds (percent) and confidence levels.
DROP_MISSING, CLIP_OUTLIERS, IDENTIFIER, MODERATE = 50.0, 10.0, 80.0, 30.0
SKEWED = 1.0
STRONG, FAIR, WEAK = 0.92, 0.75, 0.55


def _decision(action: str, confidence: float | Column, automatic: bool) -> Column:
    return F.struct(
        F.lit(action).alias("recommendation"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        F.lit(automatic).alias("auto_applicable"),
    )


def _confident(condition: Column) -> Column:
    return F.when(condition, F.lit(STRONG)).otherwise(F.lit(FAIR))


def _decisions() -> dict[str, Column]:
    """The decision for each finding type; other types get none."""
    pct = F.col("pct")
    robust = (F.col("outliers") > 0) | (F.abs("skewness") > SKEWED)
    return {
        "missing_values": F.when(pct >= DROP_MISSING, _decision("drop_column", STRONG, False))
        .when((F.col("kind") == NUMERIC) & robust, _decision("median_imputation", STRONG, True))
        .when(F.col("kind") == NUMERIC, _decision("mean_imputation", FAIR, True))
        .otherwise(_decision("mode_imputation", FAIR, True)),
        "duplicate_rows": _decision("remove_duplicates", _confident(pct > 5.0), True),
        "outliers": F.when(pct > CLIP_OUTLIERS, _decision("clip_outliers", FAIR, True)).otherwise(
            _decision("remove_outliers", STRONG, True)
        ),
        "high_cardinality": F.when(pct > IDENTIFIER, _decision("drop_column", STRONG, False))
        .when(pct > MODERATE, _decision("frequency_encoding", FAIR, True))
        .otherwise(_decision("target_encoding", WEAK, False)),
        "type_mismatch": F.when(
            F.col("target") == "datetime", _decision("cast_datetime", _confident(pct >= 95.0), True)
        ).otherwise(_decision("cast_numeric", _confident(pct >= 95.0), True)),
        "constant_column": _decision("drop_constant", STRONG, False),
        "invalid_emails": _decision("validate_emails", _confident(pct > 25.0), False),
    }


def _found(facts: TableFacts, checks: Sequence[Callable[[TableFacts], DataFrame]], skewness: bool) -> DataFrame:
    """The findings of the checks beside what the rules ask of their columns.

    Only the rule for missing values looks at outliers and skewness.
    """
    asked = (("moments",) if skewness else ()) + ("outliers",) if missing_values in checks else ()
    facts.gather(*asked, *[needed for check in checks for needed in PASSES[check]])
    about = facts.frame(*asked).select("column", "kind", "skewness", "outliers")
    return quality_issues(facts, checks).join(F.broadcast(about), "column", "left")


def recommend(facts: TableFacts, checks: Sequence[Callable[[TableFacts], DataFrame]] = CHECKS) -> DataFrame:
    """One action per finding of the checks, most severe first. Skewness counts at 4 decimals."""
    if facts.rows == 0:
        raise ValueError("an empty table has no cleaning plan")
    found = _found(facts, checks, skewness=True)
    found = found.withColumn("skewness", F.round("skewness", 4))
    decision = None
    for issue_type, choice in _decisions().items():
        condition = F.col("type") == issue_type
        decision = F.when(condition, choice) if decision is None else decision.when(condition, choice)
    return (
        found.withColumn("decision", decision)
        .where("decision is not null")
        .select(
            F.concat_ws(":", "type", "column").alias("action_id"),
            "check_no",
            "position",
            "column",
            F.col("type").alias("issue_type"),
            "severity",
            "decision.*",
            F.col("details").alias("current_state"),
            _reason().alias("reason"),
        )
        .orderBy(severity_rank(F.col("severity")), "check_no", "position")
    )


def _reason() -> Column:
    pct = number_text(F.col("pct"), 1)
    said = F.concat(F.col("decision.recommendation"), F.lit(" because of "), F.col("type"))
    return F.concat(
        said,
        F.when(F.col("pct").isNotNull(), F.concat(F.lit(" ("), pct, F.lit("%)"))).otherwise(""),
        F.when(F.col("target").isNotNull(), F.concat(F.lit(", reads as "), F.col("target"))).otherwise(""),
    )


def simple_plan(facts: TableFacts) -> DataFrame:
    """The smaller planner: outliers always removed, constants and addresses left alone."""
    found = _found(facts, CHECKS, skewness=False)
    kind = F.col("type")
    numeric = F.col("kind") == NUMERIC
    action = (
        F.when((kind == "missing_values") & numeric & (F.col("outliers") > 0), "median_imputation")
        .when((kind == "missing_values") & numeric, "mean_imputation")
        .when(kind == "missing_values", "mode_imputation")
        .when(kind == "duplicate_rows", "remove_duplicates")
        .when(kind == "outliers", "remove_outliers")
        .when((kind == "high_cardinality") & (F.col("pct") > IDENTIFIER), "drop_column")
        .when(kind == "high_cardinality", "target_encoding")
        .when(kind == "type_mismatch", "cast_datatype")
    )
    return (
        found.withColumn("action", action)
        .where("action is not null")
        .orderBy(severity_rank(F.col("severity")), "check_no", "position")
        .select(F.col("type").alias("issue"), "column", "action", F.col("details").alias("reason"))
    )
