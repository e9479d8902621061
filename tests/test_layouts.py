import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import as_timestamp
from millrace.operators import hygiene, options, quality
from millrace.operators.cleaning import Step, apply_plan
from millrace.operators.facts import TableFacts


def day(text):
    return datetime.datetime.strptime(text, "%Y-%m-%d")


CASES = [
    (["13/01/2024", "05/01/2024"], ["2024-01-13", "2024-01-05"]),  # one unambiguous cell decides for the column
    (["01/13/2024", "01/05/2024"], ["2024-01-13", "2024-01-05"]),
    (["05/01/2024", "06/01/2024"], ["2024-05-01", "2024-06-01"]),  # none does: month first
    (["13/01/2024", "01/14/2024", "02/03/2024"], [None, "2024-01-14", "2024-02-03"]),  # a tie: month first
    (["13.01.2024", "5.1.2024", "31-12-2023"], ["2024-01-13", "2024-01-05", "2023-12-31"]),
    (["2024-01-13", "14/01/2024", "15/01/2024"], ["2024-01-13", "2024-01-14", "2024-01-15"]),
    (["31/02/2024", "30/01/2024"], [None, "2024-01-30"]),
    (["13/01-2024", "1/2/24", "12/2024"], [None, None, None]),
]


@pytest.mark.parametrize("texts, expected", CASES)
def test_the_column_chooses_its_order(frame, texts, expected):
    df = frame("t string, k int", t=texts, k=range(len(texts)))
    read = apply_plan(df, [Step("cast_datatype", "t", reason="datetime")]).df.orderBy("k").collect()
    assert [row["t"] for row in read] == [value and day(value) for value in expected]
    share = TableFacts(df).text_shares["t"]
    assert share.dates == sum(value is not None for value in expected)


def test_all_operators_read_a_day_first_column(frame):
    df = frame("t string", t=["13/01/2024", "05/01/2024", "06/02/2024", None])
    expected = [day("2024-01-05"), day("2024-01-13"), day("2024-02-06")]
    facts = TableFacts(df)
    assert quality.type_mismatches(facts).first()["target"] == "datetime"
    assert hygiene.looks_like_date(facts).count() == 1
    for done in (apply_plan(df, [Step("cast_datetime", "t")]).df, options.clean(df, options.Options(parse_dates=True))[0]):
        assert sorted(row["t"] for row in done.where("t is not null").collect()) == expected


def test_times_and_orders(spark):
    row = spark.range(1).select(
        as_timestamp(F.lit("13/01/2024 7:05"), day_first=True).alias("a"), as_timestamp(F.lit("01.13.2024 07:05:09")).alias("b"),
        as_timestamp(F.lit("13-01-2024")).alias("c"), as_timestamp(F.lit("2024/01/13"), day_first=True).alias("d"),
    ).first()
    assert tuple(row) == (datetime.datetime(2024, 1, 13, 7, 5), datetime.datetime(2024, 1, 13, 7, 5, 9), None, day("2024-01-13"))
