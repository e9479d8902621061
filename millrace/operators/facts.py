"""Everything the checks, scores and rules need to know about a table.

Each property is one distributed pass over the whole table, run on first use and
reduced on the cluster to at most one record per column before it reaches the
driver. Checks then work on those records, so a full report costs a handful of
scans however many checks it holds, and a single check pays only for its own pass.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import as_number, as_timestamp, is_email, order_votes, present
from millrace.functions.values import row_digest, text_key
from millrace.operators.selection import Span, quantiles, stacked
from millrace.schema import NUMERIC, OTHER, TEXT, kinds, ref
from millrace.session import small_frame

#: Aggregates per pass; more would outgrow what Spark compiles into one loop.
COLUMNS_PER_PASS = 40
FENCE_FACTOR = 1.5
FEWEST_FOR_FENCES = 4


@dataclass(frozen=True)
class Moments:
    mean: float | None
    std: float | None
    skewness: float | None
    kurtosis: float | None


@dataclass(frozen=True)
class TextShares:
    numbers: int
    dates: int
    at_signs: int
    emails: int
    padded: bool
    day_first: bool | None = False


@dataclass(frozen=True)
class Fences:
    low: float
    high: float


def corrected_skewness(population: float | None, n: int) -> float | None:
    """Bias-corrected skewness; 0 when all values are equal, undefined below 3."""
    if n < 3:
        return None
    if population is None:
        return 0.0
    return (n * (n - 1)) ** 0.5 / (n - 2) * population


def corrected_kurtosis(population: float | None, n: int) -> float | None:
    """Bias-corrected excess kurtosis; 0 when all values are equal, undefined below 4."""
    if n < 4:
        return None
    if population is None:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)


def fences(q1: float, q3: float) -> Fences:
    spread = q3 - q1
    return Fences(q1 - FENCE_FACTOR * spread, q3 + FENCE_FACTOR * spread)


def outside(value: Column, limits: Fences) -> Column:
    return (value < F.lit(limits.low)) | (value > F.lit(limits.high))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(position, distinct)`` of the given columns, nulls not counted.

    One shuffle for all columns: cells are stacked and combined per task before
    they travel, so a value held by a third of the rows arrives once per task.
    """
    cells = [
        F.struct(F.lit(i).alias("position"), text_key(df, name).alias("value")) for i, name in enumerate(columns)
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("position", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("position")
        .agg(F.count("*").alias("distinct"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``duplicates`` (rows beyond the first of their kind, nulls and NaN equal)."""
    return (
        df.groupBy(row_digest(df).alias("row"))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    )


class TableFacts:
    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession
        self.kinds = kinds(df)
        self.columns = df.columns
        self.numeric = [c for c, k in self.kinds.items() if k == NUMERIC]
        self.text = [c for c, k in self.kinds.items() if k == TEXT]

    def _wide(self, columns: list[str], parts) -> dict[str, dict]:
        """Aggregate ``parts(name) -> {label: Column}`` for each column, a batch of columns per scan."""
        found: dict[str, dict] = {}
        for start in range(0, len(columns), COLUMNS_PER_PASS):
            batch = columns[start : start + COLUMNS_PER_PASS]
            labelled = {name: parts(name) for name in batch}
            row = self.df.agg(
                F.count("*").alias("rows"),
                *[value.alias(f"{i}_{label}") for i, name in enumerate(batch) for label, value in labelled[name].items()],
            ).first()
            for i, name in enumerate(batch):
                found[name] = {label: row[f"{i}_{label}"] for label in labelled[name]}
            self._rows = row["rows"]
        return found

    @cached_property
    def basics(self) -> dict[str, dict]:
        """Filled cells of every column, range of the numeric ones."""

        def parts(name: str) -> dict[str, Column]:
            value = present(self.df, name)
            wanted = {"filled": F.count(value)}
            if self.kinds[name] == NUMERIC:
                low, high = F.min(value), F.max(value)
                wanted |= {"low": low.cast("double"), "high": high.cast("double"), "same": low == high}
            return wanted

        return self._wide(self.columns, parts)

    @property
    def rows(self) -> int:
        self.basics
        return self._rows

    def filled(self, name: str) -> int:
        return self.basics[name]["filled"]

    def nulls(self, name: str) -> int:
        return self.rows - self.filled(name)

    @cached_property
    def spans(self) -> dict[str, Span]:
        return {c: Span(self.basics[c]["filled"], self.basics[c]["low"], self.basics[c]["high"]) for c in self.numeric}

    @cached_property
    def moments(self) -> dict[str, Moments]:
        """Mean, deviation, population skewness and kurtosis of the numeric columns.

        Stacked rather than one wide aggregate: four moment buffers per column would
        push the generated loop past what the JIT compiles.
        """
        if not self.numeric:
            return {}
        rows = (
            stacked(self.df, self.numeric)
            .groupBy("position")
            .agg(
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("std"),
                F.skewness("value").alias("skewness"),
                F.kurtosis("value").alias("kurtosis"),
            )
            .collect()
        )
        found = {self.numeric[r["position"]]: Moments(r["mean"], r["std"], r["skewness"], r["kurtosis"]) for r in rows}
        return {c: found.get(c, Moments(None, None, None, None)) for c in self.numeric}

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        return quantiles(self.df, self.numeric, [0.25, 0.5, 0.75], self.spans)

    @cached_property
    def fences(self) -> dict[str, Fences]:
        """Outlier fences of the numeric columns that have enough spread to define them."""
        return {
            c: fences(q[0], q[2])
            for c, q in self.quartiles.items()
            if self.filled(c) >= FEWEST_FOR_FENCES and q[2] != q[0]
        }

    @cached_property
    def outliers(self) -> dict[str, int]:
        """Cells outside the fences, all columns in one scan."""
        found = self._wide(
            list(self.fences),
            lambda c: {"n": F.count_if(outside(present(self.df, c).cast("double"), self.fences[c]))},
        )
        return {c: found[c]["n"] for c in found}

    @cached_property
    def text_distinct(self) -> dict[str, int]:
        return self.distinct_of(self.text)

    def distinct_of(self, columns: list[str]) -> dict[str, int]:
        if not columns:
            return {}
        rows = distinct_counts(self.df, columns).collect()
        return dict.fromkeys(columns, 0) | {columns[r["position"]]: r["distinct"] for r in rows}

    @cached_property
    def constants(self) -> dict[str, str | None]:
        """Columns with exactly one distinct value, and that value as text.

        Equal minimum and maximum say so without a shuffle.
        """
        comparable = [c for c in self.columns if self.kinds[c] != OTHER]
        others = [c for c in comparable if self.kinds[c] != NUMERIC]
        found = self._wide(
            others,
            lambda c: {
                "same": F.min(ref(c)) == F.max(ref(c)),
                "value": F.when(F.min(ref(c)) == F.max(ref(c)), F.min(ref(c)).cast("string")),
            },
        )
        constant = {c: found[c]["value"] for c in others if found[c]["same"]}
        for c in self.numeric:
            if self.basics[c]["same"]:
                whole = isinstance(self.df.schema[c].dataType, T.IntegralType)
                constant[c] = str(int(self.spans[c].low) if whole else self.spans[c].low)
        return {c: constant[c] for c in self.columns if c in constant}

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df).first()["duplicates"]

    @cached_property
    def text_shares(self) -> dict[str, TextShares]:
        """How many filled cells of each text column read as number, date or e-mail address. Dates are read in the order
        of day and month that the column's unambiguous cells choose."""
        if not self.text:
            return {}
        cells = [F.struct(F.lit(i).alias("position"), ref(name).alias("value")) for i, name in enumerate(self.text)]
        value = F.col("value")
        padded = value.startswith(" ") | value.endswith(" ")
        rows = (
            self.df.select(F.inline(F.array(*cells)))
            .where(value.isNotNull())
            .groupBy("position")
            .agg(
                F.count(as_number(value)).alias("numbers"),
                F.count(as_timestamp(value)).alias("dates"),
                F.count_if(value.contains("@")).alias("at_signs"),
                F.count_if(is_email(value)).alias("emails"),
                (F.count_if(padded) > 0).alias("padded"),
                *[votes.alias(name) for name, votes in order_votes(value).items()],
            )
            .collect()
        )
        found = {}
        for r in rows:
            more = max(r["only_day"] - r["only_month"], 0)
            found[self.text[r["position"]]] = TextShares(r["numbers"], r["dates"] + more, r["at_signs"], r["emails"], r["padded"], more > 0)
        return {c: found.get(c, TextShares(0, 0, 0, 0, False)) for c in self.text}

    @cached_property
    def numeric_distinct(self) -> dict[str, int]:
        return self.distinct_of(self.numeric)

    # -- the facts as a table ------------------------------------------------

    def gather(self, *passes: str) -> None:
        """Run the named passes side by side: their jobs are independent once the basics
        are known, and together they keep the cluster busy at each other's tail."""
        self.basics
        wanted = [p for p in dict.fromkeys(passes) if p not in self.__dict__]
        if "outliers" in wanted and "quartiles" in wanted:
            wanted.remove("quartiles")  # the outlier pass starts with them
        if len(wanted) < 2:
            return
        run = inheritable_thread_target(self.spark)(lambda name: getattr(self, name))
        with ThreadPoolExecutor(len(wanted)) as pool:
            list(pool.map(run, wanted))

    def frame(self, *passes: str) -> DataFrame:
        """One row per column with the facts of the named passes; the others stay null.

        Passes: basics (always), moments, quartiles, outliers, text_distinct,
        constants, text_shares, duplicates.
        """
        self.gather(*passes)
        basics = self.basics
        moments = self.moments if "moments" in passes else {}
        quartiles = self.quartiles if "quartiles" in passes or "outliers" in passes else {}
        outliers = self.outliers if "outliers" in passes else {}
        distinct = self.text_distinct if "text_distinct" in passes else {}
        constants = self.constants if "constants" in passes else {}
        shares = self.text_shares if "text_shares" in passes else {}
        duplicates = self.duplicates if "duplicates" in passes else None
        records = []
        for position, name in enumerate(self.columns):
            filled = basics[name]["filled"]
            m = moments.get(name, Moments(None, None, None, None))
            q = quartiles.get(name, [None, None, None])
            fence = self.fences.get(name) if quartiles else None
            share = shares.get(name, TextShares(None, None, None, None, None))
            records.append(
                (
                    position, name, self.kinds[name], self.df.schema[name].dataType.simpleString(),
                    self.rows, len(self.columns), duplicates, filled, self.rows - filled,
                    m.mean, m.std,
                    corrected_skewness(m.skewness, filled) if name in moments and filled else None,
                    corrected_kurtosis(m.kurtosis, filled) if name in moments and filled else None,
                    m.skewness, m.kurtosis,
                    basics[name].get("low"), basics[name].get("high"), q[0], q[1], q[2],
                    fence and fence.low, fence and fence.high, outliers.get(name),
                    distinct.get(name), name in constants, constants.get(name),
                    share.numbers, share.dates, share.at_signs, share.emails, share.padded,
                )
            )
        return small_frame(self.spark, records, FACTS_SCHEMA)


FACTS_SCHEMA = """
    position int, column string, kind string, data_type string,
    rows bigint, columns int, duplicates bigint, filled bigint, nulls bigint,
    mean double, std double, skewness double, kurtosis double,
    population_skewness double, population_kurtosis double,
    low double, high double, q1 double, median double, q3 double,
    fence_low double, fence_high double, outliers bigint,
    distinct bigint, constant boolean, constant_value string,
    numbers bigint, dates bigint, at_signs bigint, emails bigint, padded boolean
"""
