"""Near-duplicate documents: one-permutation signatures, banded buckets, star edges, exact confirmation.

1. Every text becomes its full set of word shingles; texts with equal sets form one class, of which one row goes on.
2. A class gets a one-permutation signature with optimal densification, cut into bands. Classes that share a band
   key share a bucket.
3. In a bucket only star edges are made, from the member that meets most others to the rest, so a bucket of m
   members gives m - 1 candidates. They are checked on full sets, and links among them are contracted.
4. Two members of a bucket that both fail its hub may still be linked. Where the members of a star are in several
   components, they are compared with each other, in blocks of bounded size inside the tasks: the difference of each
   from the hub, known from step 3, gives the exact size of every intersection. Only links leave a task, one for a
   member and a component. So a star loses no link of its buckets.

With 64 bands of 7 values a pair at similarity 0.8 shares no bucket with a probability of 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ref, require
from ..session import cut_lineage, scratch_path
from .common import arrow_map
from .fingerprints import band_keys, set_digest, shingle_set, signature
from .graph import connected_components

BANDS, ROWS = 64, 7
BLOCK = 1_000  # members of a star that are compared with each other at once
COLUMNS_AT_ONCE = 4_096  # of the incidence table that does it
KEYS_TO_BROADCAST = 1_000_000  # 8 bytes each; more keys are joined by shuffle
DOCUMENTS_AT_ONCE = 512  # whose signatures a task stacks


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(start, DOCUMENTS_AT_ONCE)
                sets = [shingle_set(text, size) for text in batch.column(1).cast(pa.binary()).to_pylist()]
                places = [i for i, found in enumerate(sets) if len(found)]
                keys: list = [None] * len(sets)
                if places:
                    stacked = np.stack([signature(sets[i], BANDS * ROWS) for i in places])
                    for place, row in zip(places, band_keys(stacked, BANDS, ROWS).view(np.int64)):
                        keys[place] = row
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array([len(found) for found in sets], pa.int64()),
                        pa.array([set_digest(found) if len(found) else None for found in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        batch.column(2),
                    ],
                    names=["id", "n_shingles", "class", "keys", "row_key"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                texts = whole.column(0).slice(start, DOCUMENTS_AT_ONCE).cast(pa.binary()).to_pylist()
                sets = [found for found in (shingle_set(text, size) for text in texts) if len(found)]
                yield pa.record_batch(
                    [pa.array([set_digest(found) for found in sets], pa.binary()),
                     pa.array([found.tobytes() for found in sets], pa.binary())],
                    names=["class", "shingles"],
                )

    return run


def _compare(percent: int):
    """Of each pair (a, b) whether it is linked, and how the set of a differs from that of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(start, DOCUMENTS_AT_ONCE)
                linked, sizes, hubs, lacks, differ = [], [], [], [], []
                for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
                    mine, hub = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                    both = len(np.intersect1d(mine, hub, assume_unique=True))
                    linked.append(100 * both >= percent * (len(mine) + len(hub) - both))
                    sizes.append(len(mine))
                    hubs.append(len(hub))
                    lacks.append(len(hub) - both)
                    differ.append(np.setxor1d(mine, hub, assume_unique=True).tobytes())
                yield pa.record_batch(
                    [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()),
                     pa.array(hubs, pa.int64()), pa.array(lacks, pa.int64()), pa.array(differ, pa.binary())],
                    names=["a", "b", "linked", "size", "hub_size", "lacks", "differs"],
                )

    return run


PAIR = "a binary, b binary, linked boolean, size long, hub_size long, lacks long, differs binary"


def links_within(rows: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between rows of one cell that are in different components, at most one for a row and a component.

    What two sets share is what the hub has, less what either lacks, plus what is in both differences: shingles that
    both lack, and shingles that both have and the hub has not.
    """
    left = [row for row in rows if row["left"]]
    right = [row for row in rows if row["right"]]
    number: dict[bytes, int] = {}
    roots = [np.array([number.setdefault(row["root"], len(number)) for row in side]) for side in (left, right)]
    if len(number) < 2:
        return []
    parts = [[np.frombuffer(row["differs"], np.uint64) for row in side] for side in (left, right)]
    values = np.concatenate(parts[0] + parts[1])
    owners = np.repeat(np.arange(len(left) + len(right)), [len(part) for part in parts[0] + parts[1]])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[column] > 1)
    _, column = np.unique(column[shared], return_inverse=True)
    owners = owners[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS_AT_ONCE):
        here = (column >= start) & (column < start + COLUMNS_AT_ONCE)
        table = np.zeros((len(left) + len(right), COLUMNS_AT_ONCE), np.float32)
        table[owners[here], column[here] - start] = 1
        common += table[: len(left)] @ table[len(left) :].T
    lacks = [np.array([row["lacks"] for row in side]) for side in (left, right)]
    sizes = [np.array([row["size"] for row in side]) for side in (left, right)]
    both = rows[0]["hub_size"] - lacks[0][:, None] - lacks[1][None, :] + common.astype(np.int64)
    linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    linked &= roots[0][:, None] != roots[1][None, :]
    found = []
    for place in np.flatnonzero(linked.any(axis=1)):
        others = np.flatnonzero(linked[place])
        _, first = np.unique(roots[1][others], return_index=True)
        found += [(left[place]["a"], right[other]["a"]) for other in others[first]]
    return found


def _compare_cells(percent: int):
    """Rows come sorted by cell; a cell is at most two blocks of one star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell: list[dict]) -> Iterator[pa.RecordBatch]:
            if found := links_within(cell, percent):
                yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

        held: list[dict] = []
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                cell = (row["b"], row["i"], row["j"])
                if cell != at and held:
                    yield from out(held)
                    held = []
                at = cell
                held.append(row)
        if held:
            yield from out(held)

    return run


def _only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose row_key is in ``keys`` (one column, distinct); broadcast only when counted to be few."""
    few = keys.count() <= KEYS_TO_BROADCAST
    return df.join(F.broadcast(keys) if few else keys, "row_key", "left_semi")


def _compared(candidates: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``candidates`` (a, b: classes) compared on full sets, which are made anew from the texts of those classes."""
    ends = candidates.select(F.col("a").alias("class")).unionByName(candidates.select(F.col("b").alias("class"))).distinct()
    keys = cut_lineage(classes.select("class", "row_key").join(ends, "class", "left_semi").select("row_key").distinct())
    sets = arrow_map(_only(texts, keys).select("text"), _sets(size), "class binary, shingles binary")
    sets = cut_lineage(sets.dropDuplicates(["class"]))
    pairs = candidates.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("one")), "a")
    pairs = pairs.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("other")), "b")
    return cut_lineage(arrow_map(pairs.select("a", "b", "one", "other"), _compare(percent), PAIR))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``, the id under its own name.

    Texts are linked when 100 * |intersection| >= ``percent`` * |union| of their distinct word shingles (A-Z in lower
    case). ``component_id`` is the smallest id that links can reach, ``kept`` whether it is the row's own id.

    Null or wordless texts have no shingles and are linked with nothing: they keep their own id. Texts with fewer
    words than a shingle are one shingle. Rows with a null id take part in linking but never name a component;
    a component of such rows only has a null ``component_id``, and each of its rows is kept. A repeated row gives a
    repeated row. Other columns of ``docs``, whatever their names, are not read.
    """
    require(docs, id_column, text_column)
    spark = docs.sparkSession
    texts = docs.select(ref(id_column).cast("long").alias("id"), ref(text_column).cast("string").alias("text"))
    texts = texts.withColumn("row_key", F.xxhash64("id", "text"))  # finds a text again, also where the id is null
    schema = "id long, n_shingles long, class binary, keys array<long>, row_key long"
    folder = scratch_path(spark, "near-dup")
    arrow_map(texts, _fingerprints(shingle), schema).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("id"), F.first("keys").alias("keys"),
        F.min(F.struct(F.col("id").isNull(), "row_key"))["row_key"].alias("row_key"),  # of a row with an id if there is one
    ).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")

    keyed = classes.select("class", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = cut_lineage(keyed.join(crowded, "key"))
    met = members.groupBy("class").agg(F.sum("crowd").alias("met"))
    hubs = members.join(met, "class").groupBy("key").agg(F.max(F.struct("met", "class")).alias("hub"))
    stars = members.join(hubs, "key").select(F.col("class").alias("a"), F.col("hub.class").alias("b")).where("a <> b").distinct()
    compared = _compared(cut_lineage(stars), classes, texts, shingle, percent)
    links = compared.where("linked").select("a", "b")

    roots = connected_components(links)
    placed = compared.join(roots, compared["a"] == roots["node"], "left").withColumn("root", F.coalesce("root", "a"))
    crowds = placed.groupBy("b").agg(F.count("*").alias("crowd"), F.min("root").alias("low"), F.max("root").alias("high"))
    rest = placed.join(crowds.where("low <> high").select("b", "crowd"), "b")
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("a", "b"), blocks).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = rest.select(
        "b", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "a", "root", "size", "hub_size", "lacks", "differs",
        (F.col("block") <= F.col("with")).alias("left"), (F.col("block") >= F.col("with")).alias("right"),
    )
    dealt = cells.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    more = cut_lineage(arrow_map(dealt, _compare_cells(percent), "a binary, b binary"))

    roots = connected_components(links.unionByName(more))
    named = classes.select("class", "id").join(roots, F.col("class") == F.col("node"), "left")
    named = named.select("class", "id", F.coalesce("root", "class").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component"))
    answer = named.join(names, "root").select("class", "component")
    found = rows.select("id", "n_shingles", "class").join(answer, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        _kept(F.col("id"), component).alias("kept"),
    )


def _kept(row_id: Column, component: Column) -> Column:
    return row_id.isNull() | row_id.eqNullSafe(component)


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id, once. All columns stay.

    Rows with a null id and rows without words are no duplicates of anything and stay. Of rows that repeat the kept
    id one stays, the one with the smallest text.
    """
    kept = near_duplicates(docs, id_column, text_column, shingle, percent).where("kept AND n_shingles > 0")
    kept = kept.select(ref(id_column).alias("id")).where("id IS NOT NULL").distinct()
    words = ref(text_column).rlike("[^\\x20\\x09-\\x0D]")
    packed = docs.select(
        F.struct(*[ref(c) for c in docs.columns]).alias("row"), ref(id_column).cast("long").alias("id"),
        F.coalesce(words, F.lit(False)).alias("worded"), ref(text_column).cast("string").alias("text"),
    )
    free = packed.where("NOT worded OR id IS NULL").select("row.*")
    groups = packed.where("worded AND id IS NOT NULL").join(kept, "id", "left_semi")
    one = groups.groupBy("id").agg(F.min_by("row", "text").alias("row"))
    return one.select("row.*").unionByName(free)
