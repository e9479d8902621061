"""Statistics of one or two columns, and patterns across the numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import number_text, pearson, present
from millrace.operators.facts import TableFacts, fences, outside
from millrace.operators.selection import quantiles
from millrace.schema import NUMERIC, columns_of, ref, require
from millrace.session import small_frame

WEAK, STRONG = 0.3, 0.7
SIGNIFICANT = 0.05
PAIRS_IN_ONE_ROW = 6
PATTERN_COLUMNS, PATTERN_COLUMNS_PAIRED, PATTERN_CORRELATION = 5, 4, 0.5


def strength(r: Column) -> Column:
    return F.when(F.abs(r) < WEAK, "weak").when(F.abs(r) < STRONG, "moderate").otherwise("strong")


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def two_sided_p(t: float, freedom: int) -> float:
    """Two-sided p-value of Student's t, by the regularised incomplete beta function."""
    if freedom > 1e7:  # there the normal distribution differs by less than rounding in the gamma functions does
        return math.erfc(abs(t) / math.sqrt(2.0))
    a, b, x = freedom / 2.0, 0.5, freedom / (freedom + t * t)
    rest = t * t / (freedom + t * t)  # 1 - x without cancellation
    if x <= 0.0 or rest <= 0.0:
        return min(max(x, 0.0), 1.0)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-rest) + b * math.log(rest)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _continued_fraction(a, b, x) / a
    return 1.0 - scale * _continued_fraction(b, a, rest) / b


def correlation_statistics(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: r over rows where both are present, their number, t and strength. Lazy."""
    require(df, first, second)
    x, y = present(df, first).cast("double"), present(df, second).cast("double")
    freedom = F.col("n") - 2
    return (
        df.agg(pearson(x, y).alias("r"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n"))
        .withColumn("t", F.col("r") * F.sqrt(freedom / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
        .withColumn("strength", strength(F.col("r")))
    )


def correlation_test(df: DataFrame, first: str, second: str) -> DataFrame:
    """``correlation_statistics`` with the p-value, computed on its single row."""
    row = correlation_statistics(df, first, second).first()
    defined = row["r"] is not None and row["n"] > 2
    p = None
    if defined:
        p = 0.0 if row["t"] is None else two_sided_p(row["t"], row["n"] - 2)
    return small_frame(
        df.sparkSession,
        [(row["r"], row["n"], row["t"], row["strength"] if defined else None, p, None if p is None else p < SIGNIFICANT)],
        "r double, n bigint, t double, strength string, p_value double, significant boolean",
    )


def trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """One row: least-squares slope of the value over its position in date order.

    Positions are global, yet no task sorts the table. Rows are first summed per date
    (combined per task, so a date held by a third of the rows is no burden); the dates
    are range-partitioned, counted up within each partition, and the offsets of the
    partitions come from a second sum over one row per partition. Rows of one date
    share the mean of their positions: their order is not defined.
    """
    require(df, date, value)
    per_date = (
        df.select(ref(date).alias("date"), present(df, value).cast("double").alias("value"))
        .dropna()
        .groupBy("date")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .repartitionByRange("date")
        .withColumn("bucket", F.spark_partition_id())
    )
    within = Window.partitionBy("bucket").orderBy("date")
    placed = per_date.withColumn("before", F.sum("n").over(within) - F.col("n"))
    per_bucket = placed.groupBy("bucket").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum(F.col("total") * (F.col("before") + (F.col("n") - 1) / 2)).alias("weighted"),
        F.min_by(F.col("total") / F.col("n"), "date").alias("first"),
        F.max_by(F.col("total") / F.col("n"), "date").alias("last"),
    )
    ahead = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # one row per partition
    n = F.col("n").cast("double")
    slope = F.try_divide(F.col("weighted") - F.col("total") * (n - 1) / 2, n * (n * n - 1) / 12)
    return (
        per_bucket.withColumn("ahead", ahead)
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.sum(F.col("weighted") + F.col("total") * F.col("ahead")).alias("weighted"),
            F.min_by("first", "bucket").alias("start_value"),
            F.max_by("last", "bucket").alias("end_value"),
        )
        .select(
            F.when(slope > 0, "increasing").otherwise("decreasing").alias("trend"),
            slope.alias("slope"),
            "start_value",
            "end_value",
            ((F.col("end_value") - F.col("start_value")) / F.nullif("start_value", F.lit(0.0)) * 100).alias("change_percent"),
        )
    )


def distribution(facts: TableFacts) -> DataFrame:
    """Moments (population skewness and kurtosis) and quartiles per numeric column."""
    return (
        facts.frame("moments", "quartiles")
        .where((F.col("kind") == NUMERIC) & (F.col("filled") > 0))
        .select(
            "position", "column", "mean", "median", "std", F.col("population_skewness").alias("skewness"),
            F.col("population_kurtosis").alias("kurtosis"), F.col("low").alias("min"), F.col("high").alias("max"),
            F.col("q1").alias("q25"), F.col("q3").alias("q75"),
        )
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(first, second, r)`` for every pair of numeric columns, from one aggregate row."""
    columns = columns_of(df, NUMERIC) if columns is None else columns
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return small_frame(df.sparkSession, [], "first string, second string, r double")
    value = {i: present(df, name).cast("double") for i, name in enumerate(columns)}
    names = [(F.lit(columns[i]).alias("first"), F.lit(columns[j]).alias("second")) for i, j in pairs]
    if len(pairs) <= PAIRS_IN_ONE_ROW:
        cells = [F.struct(*names[k], pearson(value[i], value[j]).alias("r")) for k, (i, j) in enumerate(pairs)]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    # More aggregates than the JIT compiles in one loop: one row per pair instead, combined per task.
    cells = [F.struct(F.lit(k).alias("pair"), value[i].alias("x"), value[j].alias("y")) for k, (i, j) in enumerate(pairs)]
    by_pair = df.select(F.inline(F.array(*cells))).groupBy("pair").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    labels = F.array(*[F.struct(*pair) for pair in names])
    return by_pair.select(F.element_at(labels, F.col("pair") + 1).alias("names"), "r").select("names.*", "r")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All ordered pairs including the diagonal (1 where the column varies)."""
    columns = columns_of(df, NUMERIC) if columns is None else columns
    pairs = correlation_pairs(df, columns)
    both = F.array(
        F.struct(F.col("first").alias("var1"), F.col("second").alias("var2"), F.col("r")),
        F.struct(F.col("second").alias("var1"), F.col("first").alias("var2"), F.col("r")),
    )
    varies = F.array(
        *[
            F.struct(
                F.lit(c).alias("var1"), F.lit(c).alias("var2"),
                F.when(F.stddev_samp(present(df, c)) > 0, 1.0).cast("double").alias("r"),
            )
            for c in columns
        ]
    )
    diagonal = df.agg(varies.alias("cells")).select(F.inline("cells"))
    return pairs.select(F.inline(both)).unionByName(diagonal)


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the interquartile fences of one column."""
    require(df, column)
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        return df.limit(0)
    return df.where(outside(ref(column), fences(q1, q3)) & ~F.isnan(ref(column).cast("double")))


def patterns(facts: TableFacts) -> DataFrame:
    """Distribution of the first numeric columns and their marked correlations, as sentences."""
    df, numeric = facts.df, facts.numeric
    shapes = (
        distribution(facts)
        .where(F.col("column").isin(numeric[:PATTERN_COLUMNS]))
        .select(
            F.lit("distribution").alias("type"), F.col("column").alias("first"), F.lit(None).cast("string").alias("second"),
            "mean", "std", F.lit(None).cast("double").alias("r"),
        )
    )
    pairs = correlation_pairs(df, numeric[:PATTERN_COLUMNS_PAIRED])
    links = pairs.where(F.abs("r") > PATTERN_CORRELATION).select(
        F.lit("correlation").alias("type"), "first", "second",
        F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), "r",
    )
    shape = F.concat("first", F.lit(": average "), number_text(F.col("mean")), F.lit(", spread "), number_text(F.col("std")))
    direction = F.when(F.col("r") > 0, " rise together, r = ").otherwise(" run against each other, r = ")
    link = F.concat("first", F.lit(" and "), "second", direction, number_text(F.col("r"), 3))
    sentence = F.when(F.col("type") == "distribution", shape).otherwise(link)
    return shapes.unionByName(links).withColumn("summary", sentence)
