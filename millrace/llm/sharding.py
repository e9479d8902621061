"""Shards of even size that keep linked documents together, by balanced label propagation.

Every document starts in a shard drawn from a hash of its row, so groups begin scattered. In each round documents look at
their neighbours' shards (joins of links and labels) and propose to move where most of their neighbours' weight is. A
shard takes movers only up to its free capacity: movers are counted by hash range, and ranges are let in as long as they
fit. Rounds go on until the weight of the cut links hardly falls any more. Equal texts are linked as a tree: documents to the
smallest one of their text and hash bucket, these to the smallest one of the text, so no node has many links.

Then the labels are settled, so that bytes are even and no group of equal texts that fits into a shard is divided:

* groups of more than a hundredth of a shard, which are at most a hundred for each shard, go whole to the shard of their
  label or, if that is full, to the emptiest one; those that fit nowhere are divided;
* smaller groups, in the order of their labels, fill equal parts of what room is left, each whole;
* documents without copies, and those of divided groups, fill up the shards to equal sizes, in the order of their labels.

Every step is a join or aggregation over slim rows; quotas, offsets and loads are tables of shards, ranges or parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.lookup import attach
from ..schema import ref, require
from ..session import cut_lineage, small_frame, written

SLACK = 0.3  # by which a shard may be over the mean while labels move; settling evens it out
QUOTA_RANGES = 256
GAIN, PATIENCE = 0.02, 1  # rounds end behind one more that frees less than this part of the cut links
HUB_BUCKETS = 4_096
LARGE = 100  # groups of more than this part of a shard are placed one by one


def _bucket(*columns: Column | str, count: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def propagate(
    nodes: DataFrame, links: DataFrame, shards: int, rounds: int | None = None, slack: float = SLACK, history: list[dict] | None = None
) -> DataFrame:
    """(node, size, shard) from nodes (node, size), each node once, and undirected links (a, b, weight).

    A document's neighbours pull it, each with the link's weight. It moves only to a shard that holds more of its
    neighbours' weight than its own does, and only while that shard has room: its size may not pass the mean by more
    than ``slack``. Rounds end when the weight of cut links has all but stopped falling (``GAIN``), at the latest after ``rounds``;
    ``history`` gets the weight of cut links before each round and the number of documents that moved in it.
    """
    labels = cut_lineage(nodes.select("node", "size", _bucket("node", F.lit("start"), count=shards).alias("shard")))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight")
    both = cut_lineage(both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")))
    if both.isEmpty():
        return labels
    total = labels.agg(F.sum("size")).first()[0]
    turn, least, idle = 0, None, 0
    while rounds is None or turn < rounds:
        # neighbours that follow each other would swap shards for ever: first the larger names follow the smaller
        # ones, twice for what the hubs of hubs change, then a half of all documents, another one each round, follows all
        # of its neighbours; the round is a text in the plan, so that all rounds run the same compiled code
        follows = F.col("other") < F.col("node") if turn < 2 else _bucket("node", F.lit(f"half {turn}"), count=2) == 0
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("shard").alias("near")), "other").join(labels, "node")
        # both aggregates keep the second join's partitioning by node
        pull = seen.groupBy("node", "size", "shard", "near").agg(F.sum("weight").alias("weight"), F.sum(F.when(follows, F.col("weight")).otherwise(0)).alias("pull"))
        at_home = F.col("near") == F.col("shard")
        decided = cut_lineage(
            pull.groupBy("node", "size", "shard").agg(
                F.max(F.struct("pull", (-F.col("near")).alias("near"))).alias("best"),
                F.sum(F.when(at_home, F.col("pull")).otherwise(0)).alias("here"), F.sum(F.when(~at_home, F.col("weight")).otherwise(0)).alias("cut"),
            )
        )
        cut = decided.agg(F.sum("cut")).first()[0]
        idle = 0 if least is None or cut < (1 - GAIN) * least else idle + 1
        least = cut if least is None else min(least, cut)
        if cut == 0 or idle > PATIENCE:
            break
        to, range_ = (-F.col("best.near")).alias("to"), _bucket("node", F.lit(f"range {turn}"), count=QUOTA_RANGES).alias("range")
        moves = decided.where((F.col("best.pull") > F.col("here")) & (-F.col("best.near") != F.col("shard"))).select("node", "size", to, range_)
        full = labels.groupBy(F.col("shard").alias("to")).agg(F.sum("size").alias("full"))
        asked = moves.groupBy("to", "range").agg(F.sum("size").alias("asked"))
        sums = F.sum("asked").over(Window.partitionBy("to").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        room = F.lit(total / shards * (1 + slack)) - F.coalesce("full", F.lit(0))
        let_in = asked.join(full, "to", "left").withColumns({"sums": sums, "room": room}).where("sums <= room").select("to", "range")
        granted = moves.join(F.broadcast(let_in), ["to", "range"]).select("node", "to")  # at most shards x ranges rows
        changed = labels.join(granted, "node", "left").select("node", "size", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved"))
        changed = written(changed, "labels")  # not a checkpoint: the next round joins it to itself
        if history is not None:
            history.append({"cut": cut, "moved": changed.where("moved").count()})
        labels, turn = changed.drop("moved"), turn + 1
    return labels


def running(df: DataFrame, order: Sequence[str], amount: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over all rows ahead in ``order``, which tells rows apart. Within the
    parts of a range sort, plus the sums of the parts before."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut_lineage(df.withColumn("amount", amount).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each part
    offsets = ordered.groupBy("part").agg(F.sum("amount").alias("of_part")).select("part", (F.sum("of_part").over(upto) - F.col("of_part")).alias("ahead"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ordered.withColumn("before", F.sum("amount").over(inside) - F.col("amount")).join(F.broadcast(offsets), "part")
    return summed.withColumn("before", F.col("before") + F.col("ahead")).drop("part", "ahead", "amount")


def _stretches(df: DataFrame, rooms: Sequence[float], order: Sequence[str]) -> DataFrame:
    """``df`` (size, ...) with ``shard``: rows in ``order`` fill stretches in proportion to ``rooms``, each where its
    middle lies."""
    total, free = df.agg(F.sum("size")).first()[0] or 0, sum(rooms)
    shares = rooms if free else [1.0] * len(rooms)
    bounds, upto = [], 0.0
    for share in shares[:-1]:
        upto += share
        bounds.append(upto / sum(shares) * total)
    middle = F.col("before") + F.col("size") / 2
    passed = [F.when(middle >= F.lit(bound), 1).otherwise(0) for bound in bounds]
    shard = sum(passed[1:], passed[0]) if passed else F.lit(0)
    return running(df, order, F.col("size")).withColumn("shard", shard.cast("int")).drop("before")


def settle(nodes: DataFrame, shards: int) -> DataFrame:
    """``nodes`` (node, size, digest, label, ...) with ``shard`` and ``slot``, the place within the shard from 0 on.

    All shards get equal bytes, up to one document as long as documents without copies fill them, else up to a hundredth.
    A group of equal digests is divided only if it has no room in any shard.
    """
    spark = nodes.sparkSession
    by_label = nodes.groupBy("digest", "label").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = by_label.groupBy("digest").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.max_by("label", F.struct("size", -F.col("label"))).alias("label")
    )
    groups = cut_lineage(groups)
    mean = (groups.agg(F.sum("size")).first()[0] or 0) / shards
    several = groups.where("n > 1")
    loads, fixed = [0] * shards, []
    # sizes add up to the shards, so fewer than shards x LARGE groups can be so large
    large = several.where((F.col("size") > mean / LARGE) & (F.col("size") <= mean)).select("size", "digest", "label").collect()
    for size, digest, label in sorted(large, key=lambda row: (-row["size"], row["digest"])):
        shard = label if loads[label] + size <= mean else min(range(shards), key=lambda k: (loads[k], k))
        if loads[shard] + size <= mean:
            loads[shard] += size
            fixed.append((digest, shard))
    small = several.where(F.col("size") <= mean / LARGE).withColumn("mixed", F.xxhash64("digest"))
    small = _stretches(small, [mean - load for load in loads], ["label", "mixed", "digest"]).select("digest", "shard")
    whole = cut_lineage(small.unionByName(small_frame(spark, fixed, "digest string, shard int")))
    known = cut_lineage(attach(nodes, whole, "digest").withColumn("mixed", F.xxhash64("node")))
    placed = known.where("shard IS NOT NULL")
    held = {row["shard"]: row["held"] for row in placed.groupBy("shard").agg(F.sum("size").alias("held")).collect()}
    rooms = [max(mean - held.get(shard, 0), 0) for shard in range(shards)]
    filled = _stretches(known.where("shard IS NULL").drop("shard"), rooms, ["label", "mixed", "node"])
    everywhere = placed.unionByName(filled)
    counted = running(everywhere, ["shard", "mixed", "node"], F.lit(1).cast("long"))
    numbers = everywhere.groupBy("shard").agg(F.count("*").alias("n"))
    first = numbers.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    return counted.join(F.broadcast(first), "shard").withColumn("slot", F.col("before") - F.col("first")).drop("before", "first", "mixed", "label")


def copy_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b, weight) of nodes (node, digest) with equal digests: a tree for each. A node is linked to the smallest
    of its digest and hash bucket, these to the smallest of the digest, so a text that most rows hold has no hub with a
    large share of them."""
    bucketed = nodes.withColumn("bucket", _bucket("node", F.lit("hub"), count=HUB_BUCKETS))
    hubs = bucketed.groupBy("digest", "bucket").agg(F.min("node").alias("hub"))
    members = bucketed.join(hubs, ["digest", "bucket"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    tops = hubs.groupBy("digest").agg(F.min("hub").alias("top"))
    upper = hubs.join(tops, "digest").where("hub <> top").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    return members.unionByName(upper).withColumn("weight", F.lit(1))


def _nodes(docs: DataFrame, id_column: str, text_column: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """(all that is known of each row, written once; the nodes without what is only carried). ``nth`` numbers the
    rows; the n-th row of one id and text is a node of its own, whatever order the rows were read in."""
    require(docs, id_column, text_column)
    text = F.coalesce(ref(text_column).cast("string"), F.lit(""))
    row = [F.struct(*[ref(name) for name in docs.columns]).alias("row")] if carry else []
    known = docs.select(
        ref(id_column).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("nth"), *row,
    )
    known = written(known, "shards")
    turn = F.row_number().over(Window.partitionBy("id", "digest").orderBy("nth"))
    name = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest", F.col("turn").cast("string"))
    slim = known.select("id", "size", "text_crc32", "digest", "nth").withColumn("turn", turn).withColumn("node", name)
    return known, cut_lineage(slim.drop("turn"))


def _placed(nodes: DataFrame, shards: int, history: list[dict] | None = None) -> DataFrame:
    labels = propagate(nodes.select("node", "size"), cut_lineage(copy_links(nodes.select("node", "digest"))), shards, history=history)
    return settle(cut_lineage(nodes.join(labels.select("node", F.col("shard").alias("label")), "node")), shards)


def sharded(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", history: list[dict] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` its unsigned CRC-32 (null: as empty). The law is
    ``bytes``: no shard is further from an equal share of all bytes than the largest document, or, where hardly any
    document is without a copy, than a hundredth. Documents with equal texts are linked and stay together unless no shard
    has room for all of them. ``slot`` numbers a shard's documents from 0 without gaps; ``grown_shard`` is null, for under
    this law a further shard would move documents everywhere. ``history`` is as in :func:`propagate`.

    Rows with null or repeated ids are documents of their own. Other columns are not read. An empty table gives an
    empty result.
    """
    _, nodes = _nodes(docs, id_column, text_column, carry=False)
    return _placed(nodes, shards, history).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot`` as :func:`sharded` gives them; a column of ``docs`` that has
    such a name already keeps it, and the new one gets an underscore behind it."""
    known, nodes = _nodes(docs, id_column, text_column, carry=True)
    placed = _placed(nodes, shards).select("nth", "shard", "slot")
    taken = {name.lower() for name in docs.columns}
    names = []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        names.append(name)
    joined = known.select("nth", "row").join(placed, "nth")
    return joined.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
