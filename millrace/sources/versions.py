"""Dataset versions: cleaning writes a new version beside its parent, never over it."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.cleaning import Cleaned, Step, apply_plan
from millrace.operators.facts import TableFacts
from millrace.operators.scores import improvements, quality_score, readiness_score
from millrace.sources.readers import read_parquet, write_parquet
from millrace.sources.registry import DatasetRegistry


@dataclass
class Version:
    record: dict
    cleaned: Cleaned
    report: dict


def version_name(name: str, version: int) -> str:
    """File name of a cleaned version: earlier version marks do not pile up."""
    base = name.rsplit(".", 1)[0]
    base = re.sub(r"_v\d+$", "", base)
    base = re.sub(r"^cleaned_", "", base)
    return f"cleaned_{base}_v{version}.parquet"


def register(
    registry: DatasetRegistry, df: DataFrame, path: str, user_id: str, name: str, source: str = "upload"
) -> dict:
    """Write a table as version 1 and enter it in the registry."""
    write_parquet(df, path)
    facts = TableFacts(read_parquet(registry.spark, path))
    return registry.create(
        {
            "user_id": user_id, "dataset_name": name, "original_file_type": name.rsplit(".", 1)[-1], "source": source,
            "upload_timestamp": datetime.datetime.now(datetime.timezone.utc), "row_count": facts.rows,
            "column_count": len(facts.columns), "parquet_path": path,
            "ml_readiness_score": readiness_score(facts).first()["score"],
        }
    )


def clean_version(
    registry: DatasetRegistry, dataset_id: str, steps: Sequence[Step], approved: Iterable[str] | None = None
) -> Version:
    """Run a plan on a dataset and register the result as its next version.

    The parent's size and score are in its record, as a version never changes. Those of
    the new version are taken from the written files, so the plan runs once.
    """
    parent = registry.get(dataset_id)
    if parent is None:
        raise KeyError(dataset_id)
    cleaned = apply_plan(open_version(registry.spark, parent), steps, approved)
    version = parent["dataset_version"] + 1
    name = version_name(parent["dataset_name"], version)
    path = f"{parent['parquet_path'].rsplit('/', 1)[0]}/{name}"
    write_parquet(cleaned.df, path)
    after = TableFacts(read_parquet(registry.spark, path))
    after.gather("duplicates", "text_distinct", "outliers", "text_shares", "constants")
    new = readiness_score(after).first()["score"]
    record = registry.create(
        {
            "user_id": parent["user_id"], "dataset_name": name, "original_file_type": "parquet",
            "source": parent["source"], "upload_timestamp": datetime.datetime.now(datetime.timezone.utc),
            "row_count": after.rows, "column_count": len(after.columns), "parquet_path": path,
            "ml_readiness_score": new, "quality_score": quality_score(after).first()["score"],
            "dataset_version": version, "parent_dataset_id": dataset_id,
        }
    )
    report = {
        "rows_before": parent["row_count"], "rows_after": after.rows,
        "columns_before": parent["column_count"], "columns_after": len(after.columns),
        "old_score": parent["ml_readiness_score"], "new_score": new, "improvements": improvements(cleaned.counters),
    }
    return Version(record, cleaned, report)


def restore(registry: DatasetRegistry, dataset_id: str) -> DataFrame:
    """The original table of a dataset: the first version of its lineage, which nothing overwrites.

    A lineage whose oldest record names a parent has lost its original; what is left is no substitute for it.
    """
    root = registry.lineage(dataset_id).where(F.col("nth") == 1).first()
    if root is None:
        raise KeyError(dataset_id)
    if root["parent_dataset_id"] is not None:
        raise LookupError(f"the original of {dataset_id} is gone")
    return read_parquet(registry.spark, root["parquet_path"])


def open_version(spark: SparkSession, record: dict) -> DataFrame:
    return read_parquet(spark, record["parquet_path"])
