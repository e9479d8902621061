"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue, which starts again from its head when it is through. A document's
virtual finish time is the number of its source's tokens up to its end, divided by the source's target. All copies
are sorted by that time over the whole corpus, and the mix ends where the total budget is used up. As a source is
served its target per unit of virtual time, that is at time 1: each source has then given just its target, and the
document it is in the middle of is cut there.

The queue order is the MD5 of a seed and the document's id, so a source's queue falls into even ranges of that digest.
Running totals are taken within a source's range and added to the totals of its ranges before: no source, however
large, is gathered in one task, and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ref, require
from ..session import cut_lineage

ROWS_IN_A_RANGE = 10_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes by weight; no
    target is above ``most`` times its source's size, and what is cut off there is shared again by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    #: the sources that meet their cap first come first, so all that are capped stand before all that are not
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    budget = F.sum("source_size").over(everywhere).cast("double") * F.lit(float(share))
    before = F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    after = F.sum("weight").over(everywhere) - F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")
    level = weighed.withColumns({"budget": budget, "before": before, "after": after})
    level = level.withColumn("capped", F.col("cap").cast("double") <= (F.col("budget") - F.col("before")) * F.col("weight") / F.col("after"))
    given = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everywhere), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everywhere)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("budget") - given) * F.col("weight") / open_weight)
    return level.select("source", "source_size", target.alias("target"))


def schedule(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: bool = False,
) -> DataFrame:
    """A row for each row of ``docs``: id, size, source, source_size, target, before (its source's words ahead of it
    in the queue), and, with ``carry``, the row itself as a struct ``row``."""
    require(docs, id_column, text_column, source_column)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ref(id_column).cast("string"), F.lit(""))))
    row = [F.struct(*[ref(name) for name in docs.columns]).alias("row")] if carry else []
    slim = docs.select(
        ref(id_column).alias("id"), n_words(ref(text_column)).alias("size"), ref(source_column).cast("string").alias("source"),
        digest.alias("digest"), F.xxhash64(ref(text_column)).alias("text_hash"), *row,
    )
    digits = max(0, math.ceil(math.log(max(slim.count(), 1) / ROWS_IN_A_RANGE, 16)))
    slim = slim.withColumn("range", F.substring("digest", 1, digits))
    ranges = cut_lineage(slim.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ahead = ranges.select("source", "range", (F.sum("range_size").over(up_to) - F.col("range_size")).alias("ahead"))
    plan = ahead.join(targets, ahead["source"].eqNullSafe(targets["source"])).select(ahead["source"], "range", "ahead", "source_size", "target")
    queue = Window.partitionBy("source", "range").orderBy("digest", "id", "size", "text_hash")
    place = F.row_number().over(queue)
    before = F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    queued = slim.withColumns({"place": place, "before": before})
    joined = queued.alias("q").join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")) & (F.col("q.range") == F.col("p.range")))
    return joined.select(
        F.col("id"), "size", F.col("q.source").alias("source"), F.col("q.range").alias("range"), "place", "source_size", "target",
        (F.col("before") + F.col("ahead")).alias("before"), *(["row"] if carry else []),
    )


def copies(scheduled: DataFrame, most: int = 2) -> DataFrame:
    """The mix as it is read out: a row for each copy of a document that it takes, in the order of ``finish``, the
    virtual finish time. ``taken`` words of the copy are in the mix: all, or up to the cut at the budget's end.
    The order is a range sort over the whole corpus; documents without words are in no mix."""
    turn = F.explode(F.array(*map(F.lit, range(most)))).alias("turn")
    turned = scheduled.where("size > 0").select("*", turn)
    start = F.col("before") + F.col("turn") * F.col("source_size")
    left = F.floor("target") - start
    taken = turned.withColumns({"taken": F.least(F.col("size"), left), "finish": (start + F.col("size")) / F.col("target")})
    return taken.where("taken > 0").orderBy("finish", "source", "range", "place")


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", **columns: str) -> DataFrame:
    """What the mix takes of each row of ``docs``: id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0; a null source is a source of its own, the last. Documents of size 0 and an empty table
    are taken 0 times. Rows that repeat an id and a text stand next to each other in the queue. Other columns are
    not read.
    """
    scheduled = cut_lineage(schedule(docs, weights, share, most, seed, **columns))
    taken = copies(scheduled, most).groupBy("source", "range", "place").agg(F.sum("taken").alias("taken"))
    key = [scheduled["source"].eqNullSafe(taken["source"]), scheduled["range"] == taken["range"], scheduled["place"] == taken["place"]]
    joined = scheduled.join(taken, key, "left")
    return joined.select(
        F.col("id").alias(columns.get("id_column", "doc_id")), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", **columns: str) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, once for each copy it takes, with their own columns only.
    A copy that the budget's end cuts is given whole; rows without words, which no budget pays for, do not come."""
    return copies(schedule(docs, weights, share, most, seed, carry=True, **columns), most).select("row.*")
