"""The dataset registry: a change log read as its latest records; histories of plans; lineage of versions.

Records are only ever appended. An update is a newer record of the same dataset and a
deletion a last record marked as such, so writers never rewrite what others read.
"""

from __future__ import annotations

import datetime
import json
import math
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators.facts import TableFacts
from millrace.operators.lookup import attach
from millrace.operators.scores import readiness_score
from millrace.session import cut_lineage, small_frame
from millrace.sources.commits import exists, put_if_absent

REGISTRY_SCHEMA = """
    dataset_id string, user_id string, dataset_name string, original_file_type string, source string,
    upload_timestamp timestamp, row_count bigint, column_count int, parquet_path string,
    ml_readiness_score int, quality_score int, dataset_version int, status string,
    parent_dataset_id string, source_url string, import_options string,
    revision bigint, deleted boolean
"""
FIELDS = [part.split()[0] for part in REGISTRY_SCHEMA.split(",")]
PLANS_KEPT = 10
CLOCK_MARGIN = datetime.timedelta(minutes=10)  # by which writers' clocks may differ; changes read twice do no harm


def column_catalogue(df: DataFrame) -> DataFrame:
    """Name, type, null count and exact distinct count of each column (-1 where values cannot be compared)."""
    facts = TableFacts(df)
    comparable = [c for c in facts.columns if facts.kinds[c] != "other"]
    counted = facts.distinct_of(comparable)
    records = [
        (i, c, df.schema[c].dataType.simpleString(), facts.nulls(c), counted.get(c, -1))
        for i, c in enumerate(facts.columns)
    ]
    return small_frame(
        df.sparkSession, records, "position int, name string, dtype string, null_count bigint, unique_count bigint"
    )


def ingest_record(df: DataFrame, name: str, source: str = "upload", parent: str | None = None) -> DataFrame:
    """One row describing a newly ingested table: size, readiness, version 1."""
    facts = TableFacts(df)
    return readiness_score(facts).select(
        F.lit(name).alias("dataset_name"),
        F.lit(source).alias("source"),
        F.lit(facts.rows).cast("bigint").alias("row_count"),
        F.lit(len(facts.columns)).alias("column_count"),
        F.col("score").alias("ml_readiness_score"),
        F.lit(1).alias("dataset_version"),
        F.lit("active").alias("status"),
        F.lit(parent).cast("string").alias("parent_dataset_id"),
    )


def latest_records(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest record of each key (chosen per task before the shuffle)."""
    newest = Window.partitionBy(key).orderBy(F.desc(revision))
    return log.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def newest_first(records: DataFrame, time: str, *ties: str) -> DataFrame:
    return records.orderBy(F.desc(time), *ties)


def plan_history(plans: DataFrame, owner: list[str], time: str, tie: str, keep: int = PLANS_KEPT) -> DataFrame:
    """The newest ``keep`` plans of each owner, numbered from 1 for the latest."""
    newest = Window.partitionBy(*owner).orderBy(F.desc(time), F.desc(tie))
    return plans.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= keep)


def latest_plans(plans: DataFrame, owner: list[str], time: str, tie: str) -> DataFrame:
    """The newest plan of each owner."""
    return plan_history(plans, owner, time, tie, keep=1).drop("nth")


def plan_by_id(plans: DataFrame, owner: list[str], time: str, key: str, wanted, keep: int = PLANS_KEPT) -> DataFrame:
    """One plan with its place in its owner's history; no row if there is none or it was evicted. Only the plans of its
    owner are ranked."""
    own = plans.join(F.broadcast(plans.where(F.col(key) == F.lit(wanted)).select(*owner).limit(1)), owner, "left_semi")
    return plan_history(own, owner, time, key, keep).where(F.col(key) == F.lit(wanted))


def plan_counts(plans: DataFrame, owner: list[str], keep: int = PLANS_KEPT) -> DataFrame:
    """How many plans each owner has kept."""
    return plans.groupBy(*owner).agg(F.least(F.count("*"), F.lit(keep)).cast("bigint").alias("plans"))


def evicted_plans(plans: DataFrame, owner: list[str], time: str, key: str, keep: int = PLANS_KEPT) -> DataFrame:
    """Tombstones: owner and id of every plan beyond the newest ``keep`` of its owner."""
    newest = Window.partitionBy(*owner).orderBy(F.desc(time), F.desc(key))
    return plans.select(*owner, key, time).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") > keep).select(*owner, key)


def purged(plans: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The plans that no tombstone names. A tombstone of an owner without an id takes all plans of the owner."""
    return plans.join(tombstones, tombstones.columns, "left_anti")


def _at_rest(df: DataFrame) -> DataFrame:
    """The table of a round, written out, in no more parts than a shuffle makes: unions would add parts in every round."""
    return cut_lineage(df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _parents(records: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, parent): the parent is null where there is none on record."""
    links = _at_rest(records.select(F.col(key).alias("id"), F.col(parent).alias("parent")))
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    return attach(links, known, "parent").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def lineage(records: DataFrame, dataset_id, key: str = "dataset_id", parent: str = "parent_dataset_id") -> DataFrame:
    """The versions from the root to ``dataset_id``, numbered from 1 for the oldest.

    Jumps to the parent are doubled in each round, and what was found so far takes each round's jump at once, so a chain
    of any length n takes log2(n) rounds. A chain that returns to itself is an error.
    """
    jumps = _at_rest(_parents(records, key, parent).where("parent IS NOT NULL"))
    n, length = jumps.count(), 1
    found = _at_rest(records.where(F.col(key) == F.lit(dataset_id)).select(F.col(key).alias("id"), F.lit(0).cast("bigint").alias("steps")))
    while True:
        farther = _at_rest(found.join(jumps, "id").select(F.col("parent").alias("id"), (F.col("steps") + length).alias("steps")))
        if farther.isEmpty():
            break
        if length > n:
            raise ValueError("the lineage runs in a circle")
        found = _at_rest(found.unionByName(farther))
        doubled = jumps.withColumnRenamed("id", "from").withColumnRenamed("parent", "id")
        jumps = _at_rest(attach(doubled, jumps, "id").where("parent IS NOT NULL").select(F.col("from").alias("id"), "parent"))
        length *= 2
    last = F.max("steps").over(Window.partitionBy())  # a row for each version of the chain
    placed = found.select(F.col("id").alias(key), (last - F.col("steps") + 1).alias("nth"))
    return records.join(placed, key).orderBy("nth")


def lineage_roots(records: DataFrame, key: str = "dataset_id", parent: str = "parent_dataset_id") -> DataFrame:
    """For every dataset its root and how many versions lie before it. A dataset whose parent is on no
    record any more is a root.

    Pointer doubling: each round lets every open dataset skip as far again as it has
    come, so a chain of n versions takes log2(n) joins and no pair of versions of a
    chain is ever listed. Datasets that have reached their root take no further part. A version that many datasets hang
    on is looked up once and brought to them by broadcast, so it is no hot key. Datasets that are open after log2(n)
    rounds come from a circle, which is an error.
    """
    links = _parents(records, key, parent)
    pointers = _at_rest(
        links.select(
            "id",
            F.coalesce("parent", "id").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("generation"),
            F.col("parent").isNull().alias("done"),
        )
    )
    rounds = math.ceil(math.log2(pointers.count() + 1)) + 1
    for _ in range(rounds):
        left = pointers.where(~F.col("done"))
        if left.isEmpty():
            return pointers.select(F.col("id").alias(key), "root", "generation")
        targets = left.select(F.col("root").alias("id")).distinct()
        ahead = pointers.join(targets, "id", "left_semi").select(
            F.col("id").alias("root"), F.col("root").alias("ahead_root"), F.col("generation").alias("ahead_generation"), F.col("done").alias("ahead_done")
        )
        jumped = attach(left, ahead, "root").select(
            "id", F.col("ahead_root").alias("root"), (F.col("generation") + F.col("ahead_generation")).alias("generation"), F.col("ahead_done").alias("done")
        )
        pointers = _at_rest(pointers.where("done").unionByName(jumped))
    if pointers.where(~F.col("done")).isEmpty():
        return pointers.select(F.col("id").alias(key), "root", "generation")
    raise ValueError("the lineage runs in a circle")


class DatasetRegistry:
    """Registry records of all users under one path.

    A change is a file named after the dataset and the revision it makes. Only one writer can write that name, so of two
    that start from the same revision one is refused, reads what the other wrote, and tries again: no change is lost.
    Nothing is ever rewritten; a deletion is a last revision marked as such. ``fold`` and ``load`` write a snapshot of
    all latest records as Parquet, which readers take together with the changes made since it was begun.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- the log -------------------------------------------------------------

    def _commit(self, record: dict) -> bool:
        """Whether this writer is the one who made the record's revision."""
        name = f"{quote(str(record['dataset_id']), safe='')}.{record['revision']:08d}"
        return put_if_absent(self.spark, f"{self.path}/changes/{name}.json", json.dumps(record, default=datetime.datetime.isoformat))

    def _changes(self, pattern: str = "*", since: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(REGISTRY_SCHEMA).option("pathGlobFilter", f"{pattern}.json")
        if since is not None:
            reader = reader.option("modifiedAfter", since)
        if not exists(self.spark, f"{self.path}/changes"):
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return reader.json(f"{self.path}/changes")

    def _snapshot(self) -> tuple[int, str | None, str | None]:
        """(number, path, begun) of the newest snapshot; 0 if there is none."""
        if not exists(self.spark, f"{self.path}/snapshots"):
            return 0, None, None
        marks = self.spark.read.schema("number int, path string, begun string").json(f"{self.path}/snapshots")
        newest = marks.orderBy(F.desc("number")).first()
        return tuple(newest) if newest else (0, None, None)

    def log(self) -> DataFrame:
        """All revisions that the newest snapshot has not left behind."""
        _, path, begun = self._snapshot()
        if path is None:
            return self._changes()
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(path).unionByName(self._changes(since=begun))

    def records(self) -> DataFrame:
        current = latest_records(self.log(), "dataset_id", "revision")
        return current.where("deleted is null or not deleted")

    def _save(self, records: DataFrame, number: int, begun: datetime.datetime) -> bool:
        path = f"{self.path}/tables/{uuid.uuid4().hex}"
        records.select(*FIELDS).write.parquet(path)
        mark = {"number": number, "path": path, "begun": (begun - CLOCK_MARGIN).strftime("%Y-%m-%dT%H:%M:%S")}
        return put_if_absent(self.spark, f"{self.path}/snapshots/{number:08d}.json", json.dumps(mark))

    def fold(self) -> int:
        """Write the latest revisions, deletions included, as the next snapshot; its number. Of writers that fold at the
        same time the first counts, as all fold the same log."""
        number, _, _ = self._snapshot()
        begun = datetime.datetime.now(datetime.timezone.utc)
        self._save(latest_records(self.log(), "dataset_id", "revision"), number + 1, begun)
        return number + 1

    def load(self, records: DataFrame) -> None:
        """Enter many records at once, as the first snapshot of an empty registry; fields that they lack are null."""
        begun = datetime.datetime.now(datetime.timezone.utc)
        kinds = dict(part.split() for part in REGISTRY_SCHEMA.split(","))
        given = {name: F.col(name).cast(kind) if name in records.columns else F.lit(None).cast(kind) for name, kind in kinds.items()}
        given |= {"revision": F.lit(0).cast("bigint"), "deleted": F.lit(False)}
        if not self._save(records.select(*[column.alias(name) for name, column in given.items()]), 1, begun):
            raise ValueError("the registry is not empty")

    # -- records -------------------------------------------------------------

    def create(self, record: dict) -> dict:
        defaults = {"dataset_id": str(uuid.uuid4()), "dataset_version": 1, "status": "active"}
        full = dict.fromkeys(FIELDS) | defaults | record | {"revision": 0, "deleted": False}
        if self._latest(full["dataset_id"]) or not self._commit(full):
            raise ValueError(f"there is a dataset {full['dataset_id']} already")
        return full

    def _latest(self, dataset_id) -> dict | None:
        """The newest revision of one dataset, deleted or not; of the changes only its own are read."""
        found = self._changes(f"{quote(str(dataset_id), safe='')}.*")
        _, path, _ = self._snapshot()
        if path is not None:
            found = found.unionByName(self.spark.read.schema(REGISTRY_SCHEMA).parquet(path).where(F.col("dataset_id") == F.lit(dataset_id)))
        row = found.orderBy(F.desc("revision")).first()
        return row.asDict() if row else None

    def get(self, dataset_id) -> dict | None:
        row = self._latest(dataset_id)
        return None if row is None or row["deleted"] else row

    def of_user(self, user_id: str) -> DataFrame:
        return newest_first(self.records().where(F.col("user_id") == F.lit(user_id)), "upload_timestamp", "dataset_id")

    def update(self, dataset_id, **changes) -> dict:
        """Change fields of the newest revision, however many others change it meanwhile."""
        while True:
            current = self.get(dataset_id)
            if current is None:
                raise KeyError(dataset_id)
            changed = current | changes | {"revision": current["revision"] + 1}
            if self._commit(changed):
                return changed

    def delete(self, dataset_id) -> None:
        try:
            self.update(dataset_id, deleted=True)
        except KeyError:  # another writer was first
            return

    def delete_all(self, user_id: str) -> int:
        """Mark every dataset of a user as deleted, one after the other: each is a change of its own."""
        gone = 0
        for row in self.of_user(user_id).select("dataset_id").toLocalIterator():
            self.delete(row["dataset_id"])
            gone += 1
        return gone

    def lineage(self, dataset_id: str) -> DataFrame:
        return lineage(self.records(), dataset_id)
