"""Attach a per-value number to every row without shuffling the heavy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.values import distinct_key, is_missing
from millrace.schema import ref

#: Most values sent to every executor. Keys are at most 65 characters, so this is under a megabyte.
BROADCAST_VALUES = 10_000


def per_value(df: DataFrame, column: str, figure: Column) -> DataFrame:
    """``(key, rows, figure)`` for each present value, combined per task before the shuffle."""
    return (
        df.where(~is_missing(df, column))
        .groupBy(distinct_key(df, column).alias("key"))
        .agg(F.count("*").alias("rows"), figure.alias("figure"))
    )


def replace_by_figure(
    df: DataFrame, column: str, figure: Column, most: int = BROADCAST_VALUES, adjust=lambda c: c
) -> DataFrame:
    """Replace each value of ``column`` by ``adjust(figure of its value)``; nulls stay.

    The most frequent values are looked up by broadcast. When there are more values
    than that, the rest is joined by shuffle: none of those can be a hot key any more,
    and neither nulls nor hot rows take part in that join.
    """
    table = per_value(df, column, figure)
    schema = table.select("key", "figure").schema
    ranked = table.orderBy(F.desc("rows"), "key").limit(most + 1).select("key", "figure").collect()
    frequent = F.broadcast(df.sparkSession.createDataFrame(ranked[:most], schema))

    renamed = df.columns
    key = distinct_key(df, column)
    keyed = df.withColumn("__key", key).withColumn("__absent", is_missing(df, column))
    new_value = adjust(F.col("__figure"))

    def finished(joined: DataFrame) -> DataFrame:
        return joined.withColumn(column, new_value).select(*[ref(c) for c in renamed])

    hot = keyed.join(frequent.select(F.col("key").alias("__key"), F.col("figure").alias("__figure")), "__key", "left")
    if len(ranked) <= most:
        return finished(hot)
    hot = hot.where(F.col("__figure").isNotNull() | F.col("__absent"))
    keys_only = frequent.select(F.col("key").alias("__key"))
    cold = keyed.where(~F.col("__absent")).join(keys_only, "__key", "left_anti")
    rest = table.select(F.col("key").alias("__key"), F.col("figure").alias("__figure"))
    return finished(hot).unionByName(finished(cold.join(rest, "__key", "left")))


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, in which ``key`` is unique; null where it has none (a left join).

    Keys that hold more than a ten-thousandth of all rows, of which there cannot be more than ten thousand, are looked up
    by broadcast, so no key of the rows joined by shuffle is hot. ``rows`` is read several times: give a table at rest.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__rows"))
    hot_keys = counts.where(F.col("__rows") > rows.count() / BROADCAST_VALUES).select(key)
    hot = table.join(F.broadcast(hot_keys), key, "left_semi")
    found = rows.join(F.broadcast(hot_keys), key, "left_semi").join(F.broadcast(hot), key, "left")
    others = rows.join(F.broadcast(hot_keys), key, "left_anti").join(table, key, "left")
    return found.unionByName(others)
