"""Session helpers: where shared scratch data goes and how lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "timestamp": pa.timestamp("us", "UTC"),
}

_SHIPPED: set[str] = set()


def small_frame(spark: SparkSession, records: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few records, as a local relation: expressions over it are folded
    while planning and cost no job. ``schema`` lists names and types."""
    fields = [field.split() for field in schema.split(",")]
    columns = list(zip(*records)) if records else [()] * len(fields)
    arrays = [pa.array(values, ARROW_TYPES[kind]) for values, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session,
    whose executors share the driver's disk, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet under a new path, read from there. Its estimated size is that of the files, whereas a checkpoint
    keeps the estimate of its plan, a product for joins: in a loop that number's own length would grow without bound."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later steps do not redo its shuffles
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent
        staged = Path(tempfile.mkdtemp(prefix="millrace-code-"))
        shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(staged / f"{package.name}-code"), "zip", staged, package.name))
        _SHIPPED.add(application)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with the code the function needs on every worker."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
