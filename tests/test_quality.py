import pytest

from millrace.operators import hygiene, profile, quality
from millrace.operators.facts import TableFacts


def issues(df):
    return [r.asDict() for r in quality.quality_report(TableFacts(df)).collect()]


def only(df, issue_type):
    return [i for i in issues(df) if i["type"] == issue_type]


def test_clean_table_has_no_issue(frame):
    assert issues(frame("A bigint, B string", A=range(1, 11), B=list("aaaaabbbbb"))) == []


def test_missing(frame):
    df = frame("A double, B string", A=[*map(float, range(1, 10)), None], B=list("aaaaabbbbb"))
    (issue,) = only(df, "missing_values")
    assert (issue["column"], issue["severity"], issue["pct"]) == ("A", "medium", 10.0)
    assert issue["details"] == "1 missing values (10.0%)"


@pytest.mark.parametrize("nulls, severity", [(50, "critical"), (49, "high"), (20, "high"), (19, "medium"), (5, "medium"), (4, "low")])
def test_missing_bands(frame, nulls, severity):
    df = frame("A bigint, B bigint", A=[None] * nulls + list(range(100 - nulls)), B=range(100))
    assert only(df, "missing_values")[0]["severity"] == severity


@pytest.mark.parametrize("copies, severity", [(11, "high"), (10, "medium"), (2, "medium"), (1, "low")])
def test_duplicate_bands(frame, copies, severity):
    df = frame("A bigint", A=[*range(100 - copies), *range(copies)])
    (issue,) = only(df, "duplicate_rows")
    assert (issue["count"], issue["severity"], issue["column"]) == (copies, severity, None)


def test_high_cardinality(frame):
    df = frame("A string, B bigint", A=["oak", "elm", "ash", "fir", "yew", "oak", "elm", "bay"], B=range(8))
    (issue,) = only(df, "high_cardinality")
    assert (issue["column"], issue["pct"]) == ("A", 75.0)


def test_high_cardinality_at_half_is_fine(frame):
    assert not only(frame("A string, B bigint", A=list("abcdeabcde"), B=range(10)), "high_cardinality")


def test_outliers(frame):
    df = frame("A bigint, B string", A=[*range(40, 59), -700], B=list("ab" * 10))
    (issue,) = only(df, "outliers")
    assert (issue["pct"], issue["count"]) == (5.0, 1)


def test_no_outliers_without_spread_or_values(frame):
    assert not only(frame("A bigint", A=[5, 5, 5, 5, 5, 5, 5, 900]), "outliers")
    assert not only(frame("A bigint", A=[1, 2, 900]), "outliers")


def test_type_mismatch(frame):
    df = frame("A string, B string", A=[*(f"{i}.5" for i in range(19)), "seven"], B=list("xy" * 10))
    (issue,) = only(df, "type_mismatch")
    assert (issue["column"], issue["pct"], issue["target"]) == ("A", 95.0, "numeric")


@pytest.mark.parametrize("text", ["2024-01-05", "01/05/2024", "2024/01/05", "2024-01-05 10:11:12", "2024-01-05T10:11:12.5", "2024-01-05T10:11:12Z", "2024-01-05 10:11+02:00", "1/5/2024", "2024/1/5 10:11:12", "05-Jan-2024"])
def test_date_layouts(frame, text):
    df = frame("A string, B bigint", A=[text] * 9 + ["soon"], B=range(10))
    assert only(df, "type_mismatch")[0]["target"] == "datetime"


@pytest.mark.parametrize(
    "text, number", [("12", True), (" 1.5 ", True), ("1e5", True), ("-.5", True), ("inf", True), ("nan", False), ("1.0f", False),
                     ("1d", False), ("1,000", False), ("0x1A", False), ("", False), ("True", False)],
)
def test_number_texts(spark, text, number):
    from millrace.functions import as_number
    from pyspark.sql import functions as F

    assert (spark.range(1).select(as_number(F.lit(text))).first()[0] is not None) == number


def test_constant(frame):
    df = frame("A string, B bigint, C string, D bigint", A=["x"] * 4, B=[7, 7, None, 7], C=[None] * 4, D=[1, 2, 3, 4])
    found = {i["column"]: i["severity"] for i in only(df, "constant_column")}
    assert found == {"A": "high", "B": "medium"}


def test_constant_of_neighbouring_large_numbers(frame):
    assert not only(frame("A bigint", A=[2**53, 2**53 + 1]), "constant_column")


@pytest.mark.parametrize("bad, severity", [(26, "high"), (25, "medium"), (6, "medium"), (5, None)])
def test_email_bands(frame, bad, severity):
    df = frame("email string, n bigint", email=["nobody"] * bad + [f"u{i}@x.org" for i in range(100 - bad)], n=range(100))
    found = only(df, "invalid_emails")
    assert [i["severity"] for i in found] == ([severity] if severity else [])


def test_email_column_by_content(frame):
    df = frame("contact string, n bigint", contact=["a@x.org"] * 2 + ["nobody"] * 8, n=range(10))
    assert only(df, "invalid_emails")[0]["pct"] == 80.0


def test_report_order(frame):
    df = frame(
        "A double, B string, C string",
        A=[None] * 60 + [float(i) for i in range(40)], B=["k"] * 100, C=[f"v{i}" for i in range(100)],
    )
    assert [i["severity"] for i in issues(df)] == ["critical", "high", "medium"]


def test_long_texts_are_compared_whole(frame):
    start = "x" * 5000
    df = frame("A string, B bigint", A=[start + "a", start + "b", start + "a"], B=[1, 1, 1])
    facts = TableFacts(df)
    assert facts.text_distinct == {"A": 2}
    assert facts.duplicates == 1


def test_profile(frame):
    df = frame("A double, B string", A=[1.0, None, 3.0, None, 5.0], B=["x", "y", None, "w", "v"])
    rows = {r["column"]: (r["null_count"], r["null_percentage"]) for r in profile.missing(TableFacts(df)).collect()}
    assert rows == {"A": (2, 40.0), "B": (1, 20.0)}
    repeats = frame("A bigint, B string", A=[1, 2, 1, 2, 5], B=["x", "y", "x", "y", "v"])
    assert profile.duplicates(repeats).first().asDict() == {"duplicates": 2, "percentage": 40.0}


def test_numeric_statistics(frame):
    row = profile.numeric_statistics(TableFacts(frame("A double, B double", A=[10.0, 20.0, 30.0], B=[None] * 3))).collect()
    assert [r["column"] for r in row] == ["A"]
    a = row[0]
    assert (a["mean"], a["median"], a["std"], a["min"], a["max"]) == (20, 20, 10, 10, 30)
    assert a["skewness"] == 0.0 and a["kurtosis"] is None


def test_shape_counts_kinds(frame):
    df = frame("num double, cat string, bool boolean", num=[1.0, 2.0, 3.0], cat=["a", "b", "c"], bool=[True, False, True])
    row = profile.shape(TableFacts(df)).first()
    assert (row["numeric_columns"], row["categorical_columns"]) == (1, 2)


def test_value_counts(frame):
    long = "y" * 100
    df = frame("A string", A=["b", "a", "b", "a", long, long, long, None])
    rows = [(r["value"], r["count"]) for r in profile.value_counts(df, k=2).orderBy("rank").collect()]
    assert rows == [(long, 3), ("a", 2)]


def test_personal_names():
    columns = ["customer_id", "customer_email", "phone_number", "ssn", "age", "salary"]
    assert profile.personal_names(columns) == {
        "customer_email": "[ANONYMIZED_PII_1]", "phone_number": "[ANONYMIZED_PII_2]", "ssn": "[ANONYMIZED_PII_3]",
    }


def test_second_scanner(frame):
    df = frame(
        "`my col` string, n string, e double, c bigint",
        my=[" a", "b", "c", "d"], n=["1", "2", "3", "4"], e=[None] * 4, c=[1, 1, 1, 1],
    )
    report = hygiene.cleaning_report(TableFacts(df))
    found = {(r["type"], r["column"]) for r in report.collect()}
    assert found == {
        ("missing_values", "e"), ("whitespace", "my col"), ("wrong_dtype_numeric", "n"), ("constant_column", "e"),
        ("constant_column", "c"), ("all_null_column", "e"), ("messy_column_names", None),
    }
    assert hygiene.verdict(report).first()["verdict"] == "major"
    chosen = hygiene.suggested_options(report).first().asDict()
    assert chosen["drop_high_missing"] and chosen["convert_numeric"] and not chosen["drop_duplicates"]


def test_arrays_and_maps_do_not_break_a_report(spark):
    df = spark.sql("SELECT id, array(id, 1) AS a, map('k', id) AS m, named_struct('x', id) AS s FROM range(5)")
    facts = TableFacts(df)
    assert facts.duplicates == 0
    assert facts.distinct_of(["a", "m", "s"]) == {"a": 5, "m": 5, "s": 5}
    quality.quality_report(facts).collect()
