"""Records of large text files that no single task reads: CSV with line breaks in quotes, JSON documents of one array.

Where a record ends depends on all that stands before it: a line break inside quotes ends nothing, nor does a brace inside
a string. So a file is read in ranges, each by a task of its own, as pieces that end at a line break or a closing brace.
What a piece does to the state it is read in is known without that state:

* CSV: from outside and from inside quotes it either leaves the state, turns it, or ends in one state whatever came before;
* JSON: it turns "inside a string" or not, and adds to the nesting depth, by one number if it begins outside a string and
  by another if inside.

Such effects combine. Within a range they are running sums over its pieces, taken while the range is read, for either
state it may start in; over the ranges of a file they are running sums over one row for each range, which give the state
every range starts in. Pieces are then joined to records in the order in which they are read back, so no piece is shuffled
or sorted; only the first and last record of what a task reads in one go are looked at again, as these may go on elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.session import arrow_map, scratch_path, written

#: Characters that may separate records where line breaks belong to them; the first that no record holds is taken.
SEPARATORS = ("\x1e", "\x1f", "\x1d", "\x1c", "\x02", "\x03")

# How a line of CSV is made up, without giving back what was matched.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(?:{QUOTED}"[^,]*+|[^",][^,]*+|)'
OPENS_AND_STAYS = rf"(?s)\A(?:{FIELD},)*+{QUOTED}\z"
STAYS_INSIDE = r'(?s)\A[^"]*+(?:""[^"]*+)*+\z'
CLOSED_FIRST = r'(?s)\A[^"]*+(?:""[^"]*+)*+"[^,]*+,?'
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
ESCAPED = r"\\."
BLANK = " \t\n\x0b\f\r\ufeff"

PIECE_SQL = "file string, range long, nth long, text string, ends boolean, state_0 int, state_1 int, depth_0 long, depth_1 long"
PART_SQL = "file string, range long, nth long, begins boolean, whole boolean, record string"
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
PIECE, PART = (pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, sql.split(","))]) for sql in (PIECE_SQL, PART_SQL))


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, range, nth, text): what stands between two ``end``, in the order of nth within a range. Written by the
    caller before it is used twice, as how files are cut into ranges may differ from one reading to the next."""
    lines = spark.read.option("lineSep", end).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    return lines.select(*place, F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))


def _csv_effect(text: Column) -> dict[str, Column]:
    """``turns``: 1 if the state changes; ``fixed``: the state behind the piece where it does not depend on the one before."""
    from_outside = text.contains('"') & text.rlike(OPENS_AND_STAYS)
    from_inside = text.rlike(STAYS_INSIDE) | F.regexp_replace(text, CLOSED_FIRST, "").rlike(OPENS_AND_STAYS)
    inside = F.when(text.contains('"'), from_inside).otherwise(F.lit(True))
    outside = F.coalesce(from_outside, F.lit(False))
    return {"turns": (outside & ~inside).cast("int"), "fixed": F.when(outside == inside, outside.cast("int"))}


def _depth(text: Column) -> Column:
    """Braces and brackets opened less those closed outside strings; a string left open goes to the end of the piece."""
    bare = F.regexp_replace(F.regexp_replace(text, STRING, ""), '(?s)".*', "")
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def _json_effect(text: Column) -> dict[str, Column]:
    """``turns`` as for CSV; ``outer`` and ``inner``: what a piece that begins outside or inside a string adds to the
    depth, with the closing brace behind it, which counts where the piece ends outside."""
    turns = F.length(F.regexp_replace(F.regexp_replace(text, ESCAPED, ""), '[^"]', "")) % 2
    rest = F.regexp_replace(text, r'(?s)\A[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    from_inside = F.when(F.regexp_replace(text, ESCAPED, "").contains('"'), _depth(rest)).otherwise(0)
    return {"turns": turns.cast("int"), "fixed": F.lit(None).cast("int"), "outer": _depth(text) - (turns == 0).cast("int"), "inner": from_inside - (turns == 1).cast("int")}


def _states(turns: np.ndarray, fixed: np.ndarray, start: int) -> np.ndarray:
    """The state before each piece, and behind the last one; ``fixed`` is -1 where nothing is."""
    turned = np.concatenate([[0], np.cumsum(turns)])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(fixed >= 0, np.arange(len(fixed)), -1))])
    return np.where(last >= 0, fixed[last] + turned - turned[last + 1], start + turned) % 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of pieces that follow each other in one range of a file."""
    nth = batch.column("nth").to_numpy()
    new = np.concatenate([[True], np.diff(nth) != 1])
    for name in ("file", "range"):
        new[1:] |= pc.not_equal(batch.column(name)[1:], batch.column(name)[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new).tolist()
    yield from zip(starts, [*starts[1:], batch.num_rows])


def _behind(place: tuple, opener: str, ends: list[tuple[int, int]]) -> pa.RecordBatch:
    row = (*place, -1, opener, True, *(state for state, _ in ends), *(depth for _, depth in ends))
    return pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(row, PIECE)], schema=PIECE)


def _local_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the state and depth each is read in if its range starts outside (``_0``) or inside (``_1``) a string
    or quotes. Behind a range a row with ``ends`` tells the state and depth there, and how the range begins."""
    place, opener, at = None, "", [(0, 0), (1, 0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        turns, fixed, outer, inner = (batch.column(name).to_numpy() for name in ("turns", "fixed", "outer", "inner"))
        found = np.empty((4, batch.num_rows), np.int64)
        for first, stop in _runs(batch):
            here = (batch.column("file")[first].as_py(), batch.column("range")[first].as_py())
            if here != place:
                if place:
                    yield _behind(place, opener, at)
                place, opener, at = here, batch.column("text")[first].as_py().lstrip(BLANK)[:1], [(0, 0), (1, 0)]
            for i, (state, depth) in enumerate(at):
                states = _states(turns[first:stop], fixed[first:stop], state)
                depths = depth + np.concatenate([[0], np.cumsum(np.where(states[:-1] == 0, outer[first:stop], inner[first:stop]))])
                found[i, first:stop], found[2 + i, first:stop] = states[:-1], depths[:-1]
                at[i] = (int(states[-1]), int(depths[-1]))
        told = [batch.column(name).cast(PIECE.field(name).type) for name in ("file", "range", "nth", "text")]
        told += [pa.repeat(pa.scalar(False), batch.num_rows), *map(pa.array, found)]
        yield pa.RecordBatch.from_arrays([column.cast(field.type) for column, field in zip(told, PIECE)], schema=PIECE)
    if place:
        yield _behind(place, opener, at)


def _kept_pieces(pieces: DataFrame, effect: dict[str, Column], name: str) -> DataFrame:
    effect = {"outer": F.lit(0), "inner": F.lit(0), **effect, "fixed": F.coalesce(effect["fixed"], F.lit(-1))}
    return written(arrow_map(pieces.withColumns(effect), _local_states, PIECE_SQL), name)


def _state_before(rows: Window, start: Column) -> dict[str, Column]:
    """Columns, one after the other, that end in ``state``: the state before each row, given the one at the start."""
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum("turns").over(earlier), F.lit(0))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")), ignorenulls=True).over(earlier)
    since = F.when(F.col("last").isNotNull(), F.col("last.fixed") + F.col("turned") - F.col("last.turned")).otherwise(start + F.col("turned"))
    return {"turned": turned, "last": last, "state": (since % 2).cast("int")}


def _with_steps(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    for name, column in steps.items():
        df = df.withColumn(name, column)
    return df


def _known(pieces: DataFrame) -> DataFrame:
    """Pieces with ``state`` and ``at``, the state and depth each is read in, and ``root``, the depth between two records
    of its file, which is one within an array. What each range starts in is one row for each, as many as Spark lists
    on the driver to read the files at all."""
    same = F.col("state_0") == F.col("state_1")
    ranges = pieces.where("ends").withColumns({"fixed": F.when(same, F.col("state_0")), "turns": F.when(same, 0).otherwise(F.col("state_0"))})
    over_file = Window.partitionBy("file").orderBy("range")
    ranges = _with_steps(ranges, _state_before(over_file, F.lit(0))).withColumnRenamed("state", "start")
    ranges = ranges.withColumn("added", F.when(F.col("start") == 0, F.col("depth_0")).otherwise(F.col("depth_1")))
    depth = F.coalesce(F.sum("added").over(over_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("depth")
    root = (F.first("text").over(over_file.rowsBetween(Window.unboundedPreceding, 0)) == "[").cast("int").alias("root")
    known = pieces.where("NOT ends").join(F.broadcast(ranges.select("file", "range", "start", depth, root)), ["file", "range"])
    outside = F.col("start") == 0
    return known.withColumns({
        "state": F.when(outside, F.col("state_0")).otherwise(F.col("state_1")),
        "at": F.col("depth") + F.when(outside, F.col("depth_0")).otherwise(F.col("depth_1")),
    })


def _part(place: tuple, nth: int, begins: bool, whole: bool, texts: list[str], glue: str) -> pa.RecordBatch:
    row = (*place, nth, begins, whole, glue.join(texts))
    return pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(row, PART)], schema=PART)


def _joined(glue: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces joined to records as far as they follow each other in a task. Parts that may go on, or that lack their
    beginning, are not ``whole``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, held = None, None  # place and nth that go on with what is held; (nth, begins, texts)
        for batch in batches:
            for first, stop in _runs(batch) if batch.num_rows else ():
                place = (batch.column("file")[first].as_py(), batch.column("range")[first].as_py())
                run = batch.slice(first, stop - first)
                if held and following != (*place, run.column("nth")[0].as_py()):
                    yield _part(following[:2], *held[:2], False, held[2], glue)
                    held = None
                following = (*place, run.column("nth")[-1].as_py() + 1)
                run = run.filter(run.column("kept"))
                if not run.num_rows:
                    continue
                nth, text = run.column("nth").to_numpy(), run.column("text")
                begins = np.flatnonzero(run.column("begins").to_numpy(zero_copy_only=False))
                lead = int(begins[0]) if len(begins) else run.num_rows
                if lead:
                    held = held or (int(nth[0]), False, [])
                    held[2].extend(text[:lead].to_pylist())
                if not len(begins):
                    continue
                if held:
                    yield _part(place, held[0], held[1], held[1], held[2], glue)
                if len(begins) > 1:
                    records = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), text), glue)
                    n = len(records)
                    told = [pa.repeat(pa.scalar(value, PART[i].type), n) for i, value in enumerate(place)]
                    told += [pa.array(nth[begins[:-1]]), pa.repeat(pa.scalar(True), n), pa.repeat(pa.scalar(True), n), records.cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(told, schema=PART)
                held = (int(nth[begins[-1]]), True, text[int(begins[-1]) :].to_pylist())
        if held:
            yield _part(following[:2], *held[:2], False, held[2], glue)

    return join


def _assembled(marked: DataFrame, ranges: int, glue: str) -> DataFrame:
    """(file, range, nth, first, record) from pieces whose ``begins`` says whether a record begins there; those not
    ``kept`` belong to none. ``first`` tells a file's first record."""
    pieces, context = marked.select("file", "range", "nth", "text", "begins", "kept"), marked.sparkSession.sparkContext
    # tiny ranges make tasks without rows, and each would start a Python worker: no more tasks than ranges or cores
    pieces = pieces.coalesce(max(ranges, context.defaultParallelism))
    parts = written(arrow_map(pieces, _joined(glue), PART_SQL), "records-parts")
    over_file = Window.partitionBy("file").orderBy("range", "nth").rowsBetween(Window.unboundedPreceding, 0)
    open_parts = parts.where("NOT whole").withColumn("number", F.sum(F.col("begins").cast("int")).over(over_file))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("range", "nth", "record"))), lambda part: part["record"])
    stitched = open_parts.groupBy("file", "number").agg(F.min(F.struct("range", "nth")).alias("place"), F.array_join(texts, glue).alias("record"))
    records = parts.where("whole").select("file", "range", "nth", "record")
    records = records.unionByName(stitched.select("file", "place.range", "place.nth", "record"))
    least = parts.where("begins").groupBy("file", "range").agg(F.min("nth").alias("nth")).groupBy("file").agg(F.min(F.struct("range", "nth")).alias("least"))
    first = (F.col("range") == F.col("least.range")) & (F.col("nth") == F.col("least.nth"))
    return records.join(F.broadcast(least), "file").select("file", "range", "nth", first.alias("first"), "record")


def csv_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The lines of CSV files with the states they may be read in, written once."""
    return _kept_pieces(_pieces(spark, path, "\n"), _csv_effect(F.regexp_replace("text", "\r$", "")), "csv-pieces")


def csv_records(pieces: DataFrame) -> DataFrame:
    """(file, range, nth, first, record): the records of CSV files, whatever line breaks their quoted fields hold. Empty
    lines between records are none. A quote inside a field that does not begin with one is a letter like any other."""
    outside = F.col("state") == 0
    kept = ~outside | ~F.col("text").isin("", "\r", "\ufeff")
    records = _assembled(_known(pieces).withColumns({"begins": outside, "kept": kept}), pieces.where("ends").count(), "\n")
    return records.withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "^\ufeff", ""))


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """JSON files cut behind every closing brace, with the states and depths each piece may be read in, written once."""
    return _kept_pieces(_pieces(spark, path, "}"), _json_effect(F.col("text")), "json-pieces")


def json_records(pieces: DataFrame) -> DataFrame:
    """(file, range, nth, first, record): the objects of JSON documents that are one array, or one object, each on one line."""
    begins = (F.col("at") <= F.col("root")) & (F.col("state") == 0)
    records = _assembled(_known(pieces).withColumns({"begins": begins, "kept": F.lit(True)}), pieces.where("ends").count(), "}")
    #: what lies between objects, and the end of the array, hangs on the front of the next one
    bare = F.regexp_replace(F.regexp_replace("record", "[\r\n]+", " "), r"\A[\s,\[\x{feff}]*+", "")
    records = records.withColumn("record", bare).where(~F.col("record").rlike(r"\A[\s\]]*\z"))
    return records.withColumn("record", F.when(F.col("record").startswith("{"), F.concat("record", F.lit("}"))).otherwise(F.col("record")))


def free_separator(pieces: DataFrame) -> str:
    """A character that no piece holds, to stand between records that hold line breaks."""
    used = pieces.agg(*[F.max(F.col("text").contains(mark)).alias(str(i)) for i, mark in enumerate(SEPARATORS)]).first()
    for i, mark in enumerate(SEPARATORS):
        if not used[str(i)]:
            return mark
    raise ValueError("the records use every character that could stand between them")


def as_lines(records: DataFrame, separator: str) -> str:
    """The path of text files that hold the records with a separator between, which Spark's readers split."""
    path = scratch_path(records.sparkSession, "records")
    records.select("record").write.option("lineSep", separator).text(path)
    return path
