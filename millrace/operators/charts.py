"""The data behind charts, aggregated on the cluster; only the small result leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import is_missing, percent, present
from millrace.functions.values import text_key
from millrace.operators.explore import correlation_matrix
from millrace.operators.facts import TableFacts
from millrace.schema import DATETIME, NUMERIC, TEXT, columns_of, ref
from millrace.session import small_frame

# When a chart applies.
FEW_DISTINCT, FEW_ROWS = 5, 8
PIE_MOST, BAR_MOST = 5, 20
HEAT_LEAST, HEAT_MOST = 3, 10
BINS = 10
SAMPLE_ROWS, SAMPLE_SEED = 1000, 42
CHARTED_COLUMNS = 2


def column_roles(facts: TableFacts) -> DataFrame:
    """Role of each column in a chart, and its distinct count.

    A numeric column of at most five values in a table of more than eight rows acts as
    a category; a name with ``date`` or ``time`` makes a non-numeric column a time axis.
    """
    others = [c for c in facts.columns if c not in facts.numeric]
    counted = facts.numeric_distinct | facts.distinct_of(others)
    records = [(i, name, role_of(facts, name), counted[name]) for i, name in enumerate(facts.columns)]
    return small_frame(facts.spark, records, "position int, column string, role string, distinct bigint")


def role_of(facts: TableFacts, name: str) -> str:
    kind = facts.kinds[name]
    if kind == NUMERIC:
        return "categorical" if facts.numeric_distinct[name] <= FEW_DISTINCT and facts.rows > FEW_ROWS else "numeric"
    named_as_time = any(part in name.lower() for part in ("date", "time"))
    return "datetime" if kind == DATETIME or named_as_time else "categorical"


def roles(facts: TableFacts) -> dict[str, list[str]]:
    """Column names per role, in schema order. Only numeric columns need counting for it."""
    found: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for name in facts.columns:
        found[role_of(facts, name)].append(name)
    return found


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Rows per equal-width bin between the finite minimum and maximum; the maximum is in the last bin, infinite
    values are in the bins at the ends."""
    value = present(df, column).cast("double")
    finite = F.when(F.abs(value) < float("inf"), value)
    span = df.agg(F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    low, high = span["low"], span["high"]
    if low is None:
        return small_frame(df.sparkSession, [], "bin int, bin_start double, bin_end double, count bigint")
    width = (high - low) / bins
    bin_no = F.least(F.floor((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    return (
        df.where(value.isNotNull())
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
        .select("bin", (low + F.col("bin") * width).alias("bin_start"), (low + (F.col("bin") + 1) * width).alias("bin_end"), "count")
    )


def histograms(facts: TableFacts, bins: int = BINS) -> DataFrame:
    """Histograms of the first numeric columns, from one pass over both."""
    names = roles(facts)["numeric"][:CHARTED_COLUMNS]
    found = None
    for name in names:
        one = histogram(facts.df, name, bins).withColumn("column", F.lit(name))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return small_frame(facts.spark, [], "bin int, bin_start double, bin_end double, count bigint, column string")
    return found


def box_plots(facts: TableFacts) -> DataFrame:
    """Quartiles, fences and outlier count of the first numeric columns, where outliers exist."""
    names = roles(facts)["numeric"][:CHARTED_COLUMNS]
    return (
        facts.frame("quartiles", "outliers")
        .where(F.col("column").isin(names) & (F.col("outliers") > 0))
        .select("column", "low", "q1", "median", "q3", "high", "fence_low", "fence_high", "outliers")
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_missing(df, column)).groupBy(ref(column).alias("category")).agg(F.count("*").alias("count"))


def pie(df: DataFrame, column: str, most: int = PIE_MOST) -> DataFrame:
    """Count and share per category, when there are few; otherwise no rows."""
    counts = category_counts(df, column)
    over_all = Window.partitionBy(F.lit(1))  # at most ``most + 1`` rows get here
    return (
        counts.limit(most + 1)
        .withColumn("categories", F.count("*").over(over_all))
        .withColumn("share", percent(F.col("count"), F.sum("count").over(over_all)))
        .where(F.col("categories") <= most)
        .drop("categories")
    )


def bar(df: DataFrame, column: str, least: int = PIE_MOST + 1, most: int = BAR_MOST) -> DataFrame:
    """Count per category in descending order, when there are some but not many."""
    counts = category_counts(df, column)
    over_all = Window.partitionBy(F.lit(1))  # at most ``most + 1`` rows get here
    return (
        counts.limit(most + 1)
        .withColumn("categories", F.count("*").over(over_all))
        .where(F.col("categories").between(least, most))
        .drop("categories")
        .orderBy(F.desc("count"), "category")
    )


def time_line(df: DataFrame, time: str, value: str, unit: str = "day") -> DataFrame:
    """Average of a value per time unit: the points of a line chart at any table size."""
    moment = F.date_trunc(unit, ref(time).cast("timestamp_ntz")).cast("timestamp_ntz")
    return (
        df.where(ref(time).isNotNull())
        .groupBy(moment.alias("time"))
        .agg(F.avg(present(df, value)).alias("value"), F.count(present(df, value)).alias("points"))
        .orderBy("time")
    )


def sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED, key: list[str] | None = None) -> DataFrame:
    """A repeatable sample: the rows with the smallest MD5 of the seed and the key (top-n per task, then merged).

    The key should tell rows apart; without one all columns are read for it.
    """
    texts = [F.coalesce(text_key(df, c), F.lit("")) for c in key or df.columns]
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), *texts))).limit(n)


def scatter(df: DataFrame, columns: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Sampled points of the first two numeric columns; no rows when there are fewer."""
    chosen = (columns or columns_of(df, NUMERIC))[:2]
    if len(chosen) < 2:
        return small_frame(df.sparkSession, [], "x double, y double")
    return sample(df, key=key or chosen).select(*[ref(name) for name in chosen])


def heat_map(facts: TableFacts) -> DataFrame:
    """Correlation of every ordered pair of 3 to 10 numeric columns, at 2 decimals, 0 where undefined."""
    names = roles(facts)["numeric"]
    if not HEAT_LEAST <= len(names) <= HEAT_MOST:
        return small_frame(facts.spark, [], "var1 string, var2 string, correlation double")
    cells = correlation_matrix(facts.df, names)
    return cells.select("var1", "var2", F.coalesce(F.round("r", 2), F.lit(0.0)).alias("correlation"))


def missing_rates(facts: TableFacts) -> DataFrame:
    """Share of missing cells of the columns that have any, largest first."""
    return (
        facts.frame()
        .where("nulls > 0")
        .select("column", percent(F.col("nulls"), F.col("rows")).alias("null_percentage"), "position")
        .orderBy(F.desc("null_percentage"), "position")
        .drop("position")
    )


def measure_by_category(df: DataFrame, measure: str | None = None, category: str | None = None) -> DataFrame:
    """First numeric column summed by first text column, largest first; no rows where one of them is missing."""
    measure = measure or next(iter(columns_of(df, NUMERIC)), None)
    category = category or next(iter(columns_of(df, TEXT)), None)
    if measure is None or category is None:
        return small_frame(df.sparkSession, [], "category string, total double")
    return (
        df.groupBy(ref(category).alias("category"))
        .agg(F.coalesce(F.sum(present(df, measure)), F.lit(0)).alias("total"))
        .orderBy(F.desc("total"), "category")
    )
