"""Readiness and quality scores, grades and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.facts import TableFacts
from millrace.operators.quality import MISSING_CRITICAL, quality_issues
from millrace.operators.rules import recommend
from millrace.schema import NUMERIC, TEXT
from millrace.session import small_frame

# Grade bands.
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))

# Readiness thresholds, deduction per offending column and cap per check.
EMPTY_PCT, EMPTY_EACH, EMPTY_CAP = 30, 10, 30
DUPLICATE_PCT, DUPLICATE_COST = 5, 10
MANY_DISTINCT, DISTINCT_EACH, DISTINCT_CAP = 50, 5, 15
OUTLIER_PCT, OUTLIER_EACH, OUTLIER_CAP = 10, 5, 15
TINY_ROWS, TINY_COST, SMALL_ROWS, SMALL_COST = 50, 25, 100, 15
ONE_COLUMN_COST = 20

# Quality points lost per finding.
SEVERITY_COST = {"critical": 20, "high": 10, "medium": 5, "low": 2}
MOSTLY_MISSING_COST = 20

# Points an action is expected to win back.
ACTION_GAIN = {
    "mean_imputation": 4,
    "median_imputation": 4,
    "mode_imputation": 3,
    "constant_imputation": 2,
    "drop_column": 3,
    "remove_duplicates": 8,
    "clip_outliers": 3,
    "remove_outliers": 4,
    "target_encoding": 3,
    "frequency_encoding": 3,
    "cast_numeric": 3,
    "cast_datetime": 2,
    "log_transform": 2,
    "no_action": 0,
    "drop_constant": 4,
    "validate_emails": 2,
}


def grade(score: Column) -> Column:
    letter = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        letter = letter.when(score >= least, name)
    return letter.otherwise("F")


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def size_cost(rows: Column) -> Column:
    return F.when(rows < TINY_ROWS, TINY_COST).when(rows < SMALL_ROWS, SMALL_COST).otherwise(0)


def column_count_cost(columns: Column) -> Column:
    return F.when(columns <= 1, ONE_COLUMN_COST).otherwise(0)


def _column_flags(facts: TableFacts) -> DataFrame:
    share = 100.0 / F.nullif(F.col("rows"), F.lit(0))
    return (
        facts.frame("duplicates", "text_distinct", "outliers")
        .withColumn("null_pct", F.coalesce(F.col("nulls") * share, F.lit(0.0)))
        .withColumn("duplicate_pct", F.coalesce(F.col("duplicates") * share, F.lit(0.0)))
        .withColumn("outlier_pct", F.try_divide(F.col("outliers") * 100.0, F.col("filled")))
        .withColumn("too_empty", F.col("null_pct") >= EMPTY_PCT)
        .withColumn("too_many_values", (F.col("kind") == TEXT) & (F.col("distinct") > MANY_DISTINCT))
        .withColumn("too_many_outliers", F.coalesce(F.col("outlier_pct") > OUTLIER_PCT, F.lit(False)))
    )


def _capped(flag: str, each: int, cap: int) -> Column:
    return F.least(F.count_if(F.col(flag)) * each, F.lit(cap))


def readiness_score(facts: TableFacts) -> DataFrame:
    """One row: machine-learning readiness score, grade and the points lost per check."""
    lost = {
        "missing": _capped("too_empty", EMPTY_EACH, EMPTY_CAP),
        "duplicates": F.when(F.max("duplicate_pct") > DUPLICATE_PCT, DUPLICATE_COST).otherwise(0),
        "cardinality": _capped("too_many_values", DISTINCT_EACH, DISTINCT_CAP),
        "outliers": _capped("too_many_outliers", OUTLIER_EACH, OUTLIER_CAP),
        "size": size_cost(F.max("rows")),
        "columns": column_count_cost(F.max("columns")),
    }
    total = F.lit(100)
    for check in lost:
        total = total - F.col(f"lost_{check}")
    return (
        _column_flags(facts)
        .agg(*[points.cast("int").alias(f"lost_{check}") for check, points in lost.items()])
        .withColumn("score", clamped(total))
        .withColumn("grade", grade(F.col("score")))
    )


def readiness_findings(facts: TableFacts) -> DataFrame:
    """One row per problem found and per check passed: ``check, verdict, column, value``."""
    flagged = _column_flags(facts)

    def per_column(check: str, flag: str, value: Column, applies: Column) -> DataFrame:
        problems = flagged.where(F.col(flag)).select(
            F.lit(check).alias("check"), F.lit("problem").alias("verdict"), "column", value.cast("double").alias("value")
        )
        passed = (
            flagged.agg(F.count_if(F.col(flag)).alias("bad"), F.count_if(applies).alias("applies"))
            .where("bad = 0 and applies > 0")
            .select(
                F.lit(check).alias("check"), F.lit("strength").alias("verdict"),
                F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"),
            )
        )
        return problems.unionByName(passed)

    def whole_table(check: str, bad: Column, value: Column) -> DataFrame:
        return flagged.where("position = 0").select(
            F.lit(check).alias("check"),
            F.when(bad, "problem").otherwise("strength").alias("verdict"),
            F.lit(None).cast("string").alias("column"),
            value.cast("double").alias("value"),
        )

    return (
        per_column("missing", "too_empty", F.round("null_pct", 1), F.lit(True))
        .unionByName(whole_table("duplicates", F.col("duplicate_pct") > DUPLICATE_PCT, F.round("duplicate_pct", 1)))
        .unionByName(per_column("cardinality", "too_many_values", F.col("distinct"), F.col("kind") == TEXT))
        .unionByName(per_column("outliers", "too_many_outliers", F.round("outlier_pct", 1), F.col("kind") == NUMERIC))
        .unionByName(whole_table("size", F.col("rows") < SMALL_ROWS, F.col("rows")))
        .unionByName(whole_table("columns", F.col("columns") <= 1, F.col("columns")))
    )


def quality_score(facts: TableFacts, issues: DataFrame | None = None) -> DataFrame:
    """One row: overall quality score and grade."""
    issues = quality_issues(facts) if issues is None else issues
    mostly_missing = (F.col("type") == "missing_values") & (F.col("pct") >= MISSING_CRITICAL)
    cost = F.when(mostly_missing, MOSTLY_MISSING_COST)
    for severity, points in SEVERITY_COST.items():
        cost = cost.when(F.col("severity") == severity, points)
    structure = size_cost(F.lit(facts.rows)) + column_count_cost(F.lit(len(facts.columns)))
    return issues.agg(
        clamped(F.lit(100) - F.coalesce(F.sum(cost.otherwise(2)), F.lit(0)) - structure).alias("score")
    ).withColumn("grade", grade(F.col("score")))


def estimated_score(current: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: the score expected after the actions; manual ones count half."""
    gains = small_frame(current.sparkSession, list(ACTION_GAIN.items()), "recommendation string, gain int")
    won = F.when(F.col("auto_applicable"), F.col("gain")).otherwise(F.floor(F.col("gain") / 2))
    gain = (
        actions.join(F.broadcast(gains), "recommendation", "left")
        .agg(F.coalesce(F.sum(F.coalesce(won, F.lit(0))), F.lit(0)).alias("gain"))
    )
    score = F.col("score") + gain.scalar()
    return current.select("score", "grade", F.least(F.lit(100), score).cast("int").alias("estimated_score"))


def plan_summary(facts: TableFacts) -> DataFrame:
    """One row: findings per severity, automatic actions, scores and grade."""
    actions = recommend(facts)
    counts = {
        "total_issues": F.count("*"),
        "critical_issues": F.count_if(F.col("severity") == "critical"),
        "high_risk_issues": F.count_if(F.col("severity") == "high"),
        "medium_risk_issues": F.count_if(F.col("severity") == "medium"),
        "low_risk_issues": F.count_if(F.col("severity") == "low"),
        "auto_applicable_count": F.count_if(F.col("auto_applicable")),
    }
    tally = actions.agg(*[value.alias(name) for name, value in counts.items()]).withColumn("one", F.lit(1))
    scores = estimated_score(quality_score(facts), actions).withColumn("one", F.lit(1))
    return tally.join(scores, "one").drop("one")


def compare(before: TableFacts, after: TableFacts) -> DataFrame:
    """One row: size and readiness of a table before and after cleaning."""
    sides = []
    for label, facts in (("before", before), ("after", after)):
        sides.append(
            readiness_score(facts).select(
                F.lit(1).alias("one"),
                F.lit(facts.rows).cast("bigint").alias(f"rows_{label}"),
                F.lit(len(facts.columns)).alias(f"columns_{label}"),
                F.col("score").alias(f"score_{label}"),
            )
        )
    return (
        sides[0].join(sides[1], "one").drop("one")
        .withColumn("improvement", F.col("score_after") - F.col("score_before"))
    )


def improvements(counters: dict) -> list[str]:
    """What a cleaning run achieved, one line per kind of change."""
    lines = [
        f"{label}: {counters[key]}"
        for key, label in (
            ("duplicates_removed", "duplicate rows removed"),
            ("missing_values_filled", "missing values filled"),
            ("outliers_removed", "outlier rows removed"),
        )
        if counters.get(key)
    ]
    lines += [f"column dropped: {name}" for name in counters.get("columns_dropped", [])]
    return lines + [f"column converted: {name}" for name in counters.get("types_converted", [])]

