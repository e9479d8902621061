"""Reading and writing tables: CSV, JSON, Parquet."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.schema import ref
from millrace.sources.records import as_lines, csv_pieces, csv_records, free_separator, json_pieces, json_records

# File kinds a table may come from, and how a source address is classified.
READABLE = ("csv", "json", "parquet")
CODE_HOSTS = ("github.com", "raw.githubusercontent.com")
CONTEST_HOSTS = ("kaggle.com",)
TIME_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def suffix_of(path: str) -> str:
    """File kind by suffix; a spreadsheet or unknown kind is refused."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READABLE:
        raise ValueError(f"cannot read .{suffix}; use one of {', '.join(READABLE)}")
    return suffix


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """Header row in each file; types inferred over the whole table unless a schema is given, which spares a reading.

    Quoted fields may hold line breaks. A file of any size is still read by many tasks: its records are told apart range
    by range (:mod:`millrace.sources.records`), written with another separator, and read from there; rows do not keep
    the order of the file. Say ``lines`` when each record is one line, and files are read as they are.
    """
    if lines:
        reader = spark.read.option("header", True).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    pieces = csv_pieces(spark, path)
    records = csv_records(pieces)
    separator = free_separator(pieces)
    reader = spark.read.option("escape", '"').option("lineSep", separator)
    if schema is None:
        first_file = pieces.agg(F.min("file")).first()[0]
        header = records.where(F.col("file") == F.lit(first_file)).where("first").first()
        names = _safe_names(next(csv.reader(io.StringIO(header["record"], newline="")), [])) if header else []
        if not names:
            return spark.createDataFrame([], T.StructType([]))
    path = as_lines(records.where("NOT first"), separator)
    if schema is None:
        found = [field.dataType for field in reader.option("inferSchema", True).csv(path).schema.fields]
        schema = T.StructType([T.StructField(name, found[i] if i < len(found) else T.StringType()) for i, name in enumerate(names)])
    return reader.schema(schema).csv(path)


def _safe_names(header: list[str]) -> list[str]:
    """Column names as Spark makes them: a number behind names that repeat, one for names that are missing."""
    lower = [name.lower() for name in header]
    return [f"_c{i}" if not name else f"{name}{i}" if lower.count(name.lower()) > 1 else name for i, name in enumerate(header)]


def read_json(
    spark: SparkSession, path: str, flat: bool = True, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """One JSON document per file (an array of objects, or an object), or one object per line.

    ``flat`` turns nested objects into dotted columns. A document of any size is read by many tasks: the objects of its
    array are told apart range by range (:mod:`millrace.sources.records`), written one per line, and read from there.
    """
    if not lines:
        path = as_lines(json_records(json_pieces(spark, path)), "\n")
    df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if df.columns == ["_corrupt_record"]:
        raise ValueError("the root of a JSON table must be an array or an object")
    return flatten(df) if flat else df


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to dotted columns, at any depth; arrays stay as they are."""
    return df.select(*_leaves(df.schema, [], []))


def _leaves(struct: T.StructType, path: list[str], found: list[Column]) -> list[Column]:
    for field in struct.fields:
        here = [*path, field.name]
        if isinstance(field.dataType, T.StructType):
            _leaves(field.dataType, here, found)
        else:
            value = ref(here[0])
            for part in here[1:]:
                value = value.getField(part)
            found.append(value.alias(".".join(here)))
    return found


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix and refuse an empty table."""
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    return validated(readers[suffix_of(path)](spark, path))


def validated(df: DataFrame) -> DataFrame:
    """The table itself, or an error when it has no columns or no rows."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def write_parquet(df: DataFrame, path: str) -> str:
    """Write to a new path: a table is never overwritten while it may be read."""
    df.write.mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Times keep their microseconds, which Spark's default CSV layout would cut."""
    writer = df.write.mode("errorifexists").option("header", True).option("escape", '"')
    writer = writer.option("timestampFormat", f"{TIME_LAYOUT}XXX").option("timestampNTZFormat", TIME_LAYOUT)
    writer.csv(path)
    return path


def source_of(url: Column) -> Column:
    """Where a table came from: github, kaggle or cloud."""
    def mentions(hosts: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for host in hosts:
            hit = hit | url.contains(host)
        return hit

    return F.when(mentions(CODE_HOSTS), "github").when(mentions(CONTEST_HOSTS), "kaggle").otherwise("cloud")
