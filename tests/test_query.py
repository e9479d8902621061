import math

import pytest
from pyspark.sql import functions as F

from frames import values
from millrace.operators import query
from millrace.operators.query import QuerySpec


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("East", "A", 100, 10, "Jan"), ("West", "B", 200, 20, "Jan"), ("East", "B", 150, 15, "Feb"),
        ("West", "A", 300, 30, "Feb"), ("East", "A", 250, 25, "Mar"), ("North", "C", 80, 8, "Jan"),
        ("North", "C", 120, 12, "Feb"), ("South", "B", 180, 18, "Mar"),
    ]
    return spark.createDataFrame(rows, "region string, product string, sales bigint, quantity bigint, month string")


@pytest.mark.parametrize("function, expected", [("sum", 1380), ("mean", 172.5), ("max", 300), ("min", 80)])
def test_aggregates(sales, function, expected):
    assert query.aggregate(sales, function, "sales").first()[0] == expected


def test_count_and_distinct(sales):
    assert query.count(sales).first()[0] == 8
    assert query.distinct_count(sales, "region").first()[0] == 4


def test_group_sum_in_key_order(sales):
    rows = query.group_aggregate(sales, "sum", "sales", "region").collect()
    assert [tuple(r) for r in rows] == [("East", 500), ("North", 200), ("South", 180), ("West", 500)]


def test_filter_then_aggregate(sales):
    east = query.filter_rows(sales, "region", "==", "East")
    assert query.aggregate(east, "sum", "sales").first()[0] == 500


def test_correlation(sales):
    assert query.correlation(sales, "sales", "quantity").first()[0] == 1.0


def test_specs_run_the_same_operators(sales):
    assert query.run(sales, QuerySpec("count")).first()[0] == 8
    assert query.run(sales, QuerySpec("aggregate", "sales", "mean")).first()[0] == 172.5
    assert query.run(sales, QuerySpec("group", "sales", "max", "region")).count() == 4
    assert query.run(sales, QuerySpec("filter", "sales", comparison=">=", literal=200)).count() == 3
    with pytest.raises(ValueError):
        query.run(sales, QuerySpec("pivot"))


def test_unknown_column_and_text_mean_are_errors(sales):
    with pytest.raises(ValueError):
        query.aggregate(sales, "sum", "price")
    with pytest.raises(ValueError):
        query.aggregate(sales, "mean", "region")


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (math.nan, None), (3.0, "a")], "x double, k string")
    assert query.aggregate(df, "sum", "x").first()[0] == 4.0
    assert query.aggregate(df, "mean", "x").first()[0] == 2.0
    assert query.filter_rows(df, "x", ">", 2.0).count() == 1  # NaN is missing, not large
    assert query.filter_rows(df, "k", "!=", "a").count() == 2  # missing keys differ from everything
    assert [r["k"] for r in query.group_aggregate(df, "sum", "x", "k").collect()] == ["a", "b"]
    empty = df.where(F.lit(False))
    assert query.aggregate(empty, "sum", "x").first()[0] == 0


def test_result_cap(spark):
    df = spark.range(1000).toDF("x")
    assert query.capped(df, ["x"]).count() == 500
    assert query.truncation(df).first().asDict() == {"truncated": True, "total_rows": 1000, "returned_rows": 500}


def test_head_page_top(sales):
    assert values(query.head(sales, ["sales"], 3), "sales") == [80, 100, 120]
    assert values(query.page(sales, ["sales"], 1, 3), "sales") == [150, 180, 200]
    assert values(query.top_groups(sales, "sales", "region", 2), "region") == ["East", "West"]


def test_describe(sales):
    row = query.describe(sales).where("column = 'sales'").first()
    assert (row["count"], row["min"], row["q25"], row["q50"], row["q75"], row["max"]) == (8, 80, 115, 165, 212.5, 300)


def test_adhoc_sql(sales):
    assert query.sql(sales, "SELECT max(sales) AS m FROM {dataset} WHERE month = 'Jan'").first()["m"] == 200


def test_filter_literal_keeps_case_and_decimals():
    assert query.literal_of("East") == "East"
    assert query.literal_of("10.5") == 10.5
    assert query.literal_of("7") == 7


def test_filters_reach_the_scan(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    sales.write.parquet(path)
    plan = query.aggregate(query.filter_rows(spark.read.parquet(path), "sales", ">", 100), "sum", "quantity")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(sales,100)" in text and "product" not in text
