import random

import pytest

from millrace.operators import rules, scores
from millrace.operators.cleaning import steps_of, apply_plan
from millrace.operators.facts import TableFacts


def ready(df):
    row = scores.readiness_score(TableFacts(df)).first()
    return row["score"], row["grade"]


def test_readiness_of_a_good_table(frame):
    assert ready(frame("A bigint, B string", A=range(120), B=list("abcde") * 24)) == (100, "A")


def test_readiness_with_an_empty_column(frame):
    df = frame("A double, B bigint, C string", A=[None] * 40 + [float(i) for i in range(80)], B=range(120), C=list("abcde") * 24)
    assert ready(df)[0] == 90


def test_readiness_of_small_tables(frame):
    assert ready(frame("A bigint, B double", A=range(40), B=[float(i) for i in range(40)]))[0] == 75
    assert ready(frame("A bigint", A=range(40)))[0] == 55


def test_readiness_of_an_empty_column_table(frame):
    assert ready(frame("A double", A=[None] * 10)) == (35, "F")


def test_findings(frame):
    df = frame("A bigint, B double", A=range(40), B=[float(i) for i in range(40)])
    found = {(r["check"], r["verdict"]) for r in scores.readiness_findings(TableFacts(df)).collect()}
    assert ("size", "problem") in found and ("columns", "strength") in found and ("missing", "strength") in found
    assert not any(check == "cardinality" for check, _ in found)


@pytest.mark.parametrize("score, letter", [(100, "A"), (90, "A"), (89, "B"), (75, "B"), (74, "C"), (60, "C"), (59, "D"), (40, "D"), (39, "F")])
def test_grades(spark, score, letter):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scores.grade(F.lit(score))).first()[0] == letter


@pytest.fixture(scope="module")
def dirty(frame):
    return frame(
        "salary double, category string, code string",
        salary=[50000.0, None, 52000.0, 51000.0, None, 53000.0, 200000.0, 49000.0, None, 50500.0],
        category=["a", "b", None, "a", "b", "a", "a", "b", "a", "a"],
        code=[*map(str, range(1, 10)), "not_a_num"],
    )


def test_plan_for_a_dirty_table(dirty):
    facts = TableFacts(dirty)
    actions = {(r["issue_type"], r["column"]): r for r in rules.recommend(facts).collect()}
    assert actions[("missing_values", "salary")]["recommendation"] == "median_imputation"
    assert actions[("missing_values", "category")]["recommendation"] == "mode_imputation"
    assert actions[("type_mismatch", "code")]["recommendation"] == "cast_numeric"
    assert actions[("type_mismatch", "code")]["confidence"] == 0.75
    assert actions[("high_cardinality", "code")]["recommendation"] == "drop_column"
    assert not actions[("high_cardinality", "code")]["auto_applicable"]
    summary = scores.plan_summary(facts).first()
    assert summary["total_issues"] == len(actions)
    assert summary["estimated_score"] > summary["score"]


def test_mean_or_median(frame):
    level = frame("A double, B bigint", A=[*map(float, range(1, 10)), None], B=range(10))
    skewed = frame("A double, B bigint", A=[*map(float, [10, 11, 10, 11, 10, 11, 10, 11, 100]), None], B=range(10))
    for df, action in ((level, "mean_imputation"), (skewed, "median_imputation")):
        (row,) = rules.recommend(TableFacts(df)).where("issue_type = 'missing_values'").collect()
        assert row["recommendation"] == action


def test_clean_table_has_no_plan(frame):
    rng = random.Random(42)
    df = frame(
        "age double, income double, gender string",
        age=[rng.uniform(20, 60) for _ in range(200)], income=[rng.uniform(30000, 100000) for _ in range(200)],
        gender=["M", "F"] * 100,
    )
    assert rules.recommend(TableFacts(df)).count() == 0
    assert scores.quality_score(TableFacts(df)).first()["score"] == 100


def test_empty_table_is_an_error(dirty):
    with pytest.raises(ValueError):
        rules.recommend(TableFacts(dirty.limit(0)))


def test_simple_plan(dirty):
    actions = {(r["issue"], r["column"]): r["action"] for r in rules.simple_plan(TableFacts(dirty)).collect()}
    assert actions[("missing_values", "salary")] == "median_imputation"
    assert actions[("outliers", "salary")] == "remove_outliers"
    assert actions[("type_mismatch", "code")] == "cast_datatype"


def test_recommended_steps_can_be_run(dirty):
    actions = rules.recommend(TableFacts(dirty)).where("auto_applicable")
    done = apply_plan(dirty, steps_of(actions))
    assert dict(done.df.dtypes)["code"] == "bigint"
    assert done.df.where("salary is null or category is null").count() == 0
    row = scores.compare(TableFacts(dirty), TableFacts(done.df)).first()
    assert row["rows_before"] == 10 and row["rows_after"] == done.df.count()
