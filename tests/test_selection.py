import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import DataFrame

from millrace.operators.selection import BUCKETS, SMALL_BRACKET, quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def assert_exact(spark, columns, small=5):
    length = max(len(v) for v in columns.values())
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(length)]
    df = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in columns))
    found = quantiles(df, list(columns), PROBABILITIES, small=small)
    for name, data in columns.items():
        filled = [x for x in data if x is not None and not math.isnan(x)]
        if not filled:
            assert found[name] == [None] * len(PROBABILITIES)
            continue
        assert found[name] == pytest.approx(np.quantile(filled, PROBABILITIES).tolist(), rel=1e-15), name


def test_several_columns_and_shapes(spark):
    rng = random.Random(7)
    assert_exact(
        spark,
        {
            "uniform": [rng.uniform(-5, 5) for _ in range(4000)],
            "stretched": [math.exp(rng.gauss(0, 12)) for _ in range(4000)],
            "hot": [1.0] * 1500 + [rng.uniform(0, 2) for _ in range(2500)],
            "two": [0.0, 1.0] * 2000,
            "with_gaps": [rng.gauss(0, 1) if i % 3 else None for i in range(4000)],
            "nan": [math.nan if i % 4 == 0 else float(i) for i in range(4000)],
            "empty": [None] * 4000,
            "constant": [3.5] * 4000,
        },
    )


def test_far_outlier_does_not_stop_the_search(spark):
    rng = random.Random(3)
    assert_exact(spark, {"x": [rng.random() * 1e-9 for _ in range(3000)] + [1e300, -1e250]})


def test_infinite_values(spark):
    data = [float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, float("inf")]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    assert quantiles(df, ["x"], [0.25, 0.5], small=2)["x"] == [1.75, 3.5]


def test_large_whole_numbers(spark):
    df = spark.range(0, 50_000).selectExpr("id * 7 AS x")
    assert quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == np.quantile(np.arange(50_000) * 7, [0.25, 0.5, 0.75]).tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=60))
def test_any_values(spark, data):
    assert_exact(spark, {"x": data}, small=3)


class Scans:
    """Counts the aggregates over a frame, and the rows they bring to the driver."""

    def __init__(self, monkeypatch):
        self.scans = self.rows = 0
        collect, first = DataFrame.collect, DataFrame.first

        def collected(df):
            found = collect(df)
            self.scans, self.rows = self.scans + 1, self.rows + len(found)
            return found

        monkeypatch.setattr(DataFrame, "collect", collected)
        monkeypatch.setattr(DataFrame, "first", lambda df: collected(df)[0])


@pytest.mark.parametrize("shape", ["two humps", "wide exponents", "one value and a tail"])
def test_scans_and_rows_are_bounded_for_any_distribution(spark, monkeypatch, shape):
    rng = np.random.default_rng(5)
    data = {
        "two humps": np.concatenate([rng.uniform(0, 0.1, 50_000), rng.uniform(1000, 1000.1, 50_000)]),
        "wide exponents": 10.0 ** rng.uniform(-300, 300, 100_000),
        "one value and a tail": np.concatenate([np.full(60_000, 7.0), rng.exponential(1e-9, 40_000)]),
    }[shape]
    df = spark.createDataFrame([(float(x),) for x in data], "x double").coalesce(4).cache()
    df.count()
    counted = Scans(monkeypatch)
    found = quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.9])["x"]
    assert found == pytest.approx(np.quantile(data, [0.1, 0.25, 0.5, 0.75, 0.9]).tolist(), rel=1e-15)
    assert counted.scans <= 5
    assert counted.rows <= BUCKETS + 5 * SMALL_BRACKET + 3
