"""Stretches of a text that repeat a sequence of words at least four times over, found exactly at every period.

A run is a stretch of words that equals itself ``period`` words on, has no smaller period and cannot be made longer on
either side. Periods are searched by octave, from m to 2m - 1 words for each power of two m:

* A document that does not fit into one tile is exploded into overlapping tiles: short ones for small periods, for each
  further octave tiles of twice the size. Two neighbours share four times the largest period that is searched in them, so
  of any run at least one tile holds either all or a piece that its neighbours' pieces overlap.
* Each tile is solved by itself, on whichever executor it came to. At every boundary, that is every 2m words, one looks
  which of the next words a period on begin the same m words (hashes of blocks of that length, made by doubling); a run
  of the octave is seen at one boundary at least. What is seen is extended to both sides word by word, which are the
  boundary's two Z values for that period, cut off where the tile ends.
* The fragments are shuffled by document and period and stitched where they overlap by the period or more.

Periodic text is many-fold periodic: at a boundary inside a run of period d all multiples of d match. If the two first
matches lie d apart and the 2m words from the boundary on have period d, its multiples are no smallest periods and go
before anything is extended, so a tile costs m extensions at most whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ref, require
from ..session import cut_lineage, scratch_path
from .common import arrow_map

LEAST_WORDS, LEAST_PERIODS = 6, 4
TILE = 4_096  # words of a tile for the small periods
PERIODS = TILE // 16  # below this they are searched in the smallest tiles; a tile has room for 16 of its largest period
WHOLE_BYTES = 2 * TILE  # a text of so many bytes has at most half as many words and one
BATCH_BYTES = 4 << 20  # of texts that are solved in one array
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Found = list[tuple[int, int, int]]  # start, end, period


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: just what separates the words of a byte string."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _primes(number: int) -> list[int]:
    found, factor = [], 2
    while factor * factor <= number:
        if number % factor == 0:
            found.append(factor)
            while number % factor == 0:
                number //= factor
        factor += 1
    return found + [number] if number > 1 else found


def _forward(codes: np.ndarray, place: int, period: int) -> int:
    """The first place from ``place`` on that differs from the one a period on."""
    stop, step = len(codes) - period, 32
    while place < stop:
        upto = min(place + step, stop)
        differ = codes[place:upto] != codes[place + period : upto + period]
        first = int(differ.argmax())
        if differ[first]:
            return place + first
        place, step = upto, 4 * step
    return place


def _backward(codes: np.ndarray, place: int, period: int) -> int:
    """The smallest start of a stretch up to ``place`` that equals what stands a period on."""
    step = 32
    while place > 0:
        since = max(place - step, 0)
        differ = codes[since:place] != codes[since + period : place + period]
        last = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - last]:
            return place - last
        place, step = since, 4 * step
    return place


def _seen(hashes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) where m words from a boundary on stand again a period of m to 2m - 1 words on."""
    rows = -(-len(hashes) // (2 * m))
    padded = np.zeros(rows * 2 * m, np.uint64)
    padded[: len(hashes)] = hashes
    table = padded.reshape(rows, 2 * m)
    row, column = np.nonzero(table[:, m:] == table[:, :1])
    at, period = row * (2 * m), column + m
    several = np.flatnonzero(row[1:] == row[:-1])
    if len(several):
        step = np.full(rows, 2 * m)
        np.minimum.at(step, row[several], period[several + 1] - period[several])
        many = np.unique(row[several])
        c, d = many * (2 * m), step[many]
        inside = c + m < len(hashes)
        c, d, many = c[inside], d[inside], many[inside]
        periodic = (hashes[c] == hashes[c + d]) & (hashes[c + m - d] == hashes[c + m])
        root = np.full(rows, 2 * m)  # divides no period of the octave
        root[many[periodic]] = d[periodic]
        left = period % root[row] != 0
        at, period = at[left], period[left]
    order = np.lexsort((at, period))
    return at[order], period[order]


def solve(codes: np.ndarray, longest: int, least_period: int = 1) -> Found:
    """Runs of at least max(6, four periods) words in ``codes``; equal numbers are equal words. Periods are those of the
    octaves from ``least_period``, a power of two, up to a quarter of ``longest`` words."""
    found: Found = []
    hashes, m = _mixed(codes.astype(np.uint64), codes.astype(np.uint64) + np.uint64(1)), 1
    while LEAST_PERIODS * m <= longest and 2 * m <= len(codes):
        if m >= least_period:
            at, period = _seen(hashes, m)
            firsts = np.flatnonzero(np.diff(period, prepend=-1))
            for first, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), len(period)]):
                q, here, place = int(period[first]), at[first:stop], 0
                while place < len(here):
                    c = int(here[place])
                    end = _forward(codes, c, q)
                    if end > c:
                        start = _backward(codes, c, q)
                        if end + q - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and not any(
                            np.array_equal(codes[start : start + q], codes[start + q // p : start + q + q // p]) for p in _primes(q)
                        ):
                            found.append((start, end + q, q))
                    place = max(place + 1, int(np.searchsorted(here, end)))
        hashes = _mixed(hashes[:-m], hashes[m:])
        m *= 2
    return found


def solve_all(parts: list[np.ndarray], least_period: int = 1) -> list[Found]:
    """:func:`solve` for each of ``parts``, which lie in one array with a number of its own behind each."""
    sizes = np.array([len(part) for part in parts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    joined = np.empty(int(sizes.sum()) + len(parts), np.int64)
    for number, (begin, part) in enumerate(zip(begins.tolist(), parts)):
        joined[begin : begin + len(part)] = part
        joined[begin + len(part)] = -1 - number
    found: list[Found] = [[] for _ in parts]
    for start, end, period in solve(joined, int(sizes.max(initial=0)), least_period):
        owner = int(np.searchsorted(begins, start, "right")) - 1
        begin = int(begins[owner])
        found[owner].append((start - begin, end - begin, period))
    return [sorted(of_part) for of_part in found]


def coded(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run (start, end, period) holds behind its first period, with one space between."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, end, period in runs:
            depth[start + period] += 1
            depth[end] -= 1
        keep = np.cumsum(depth[:-1]) == 0
        words = [word for word, kept in zip(words, keep.tolist()) if kept]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _as_structs(runs: Found) -> list[dict[str, int]]:
    return [{"start": start, "length": end - start, "period": period} for start, end, period in sorted(runs, key=lambda run: (run[0], run[2]))]


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and collapsed texts of documents that are one tile each."""
    for whole in batches:
        rows = max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))
        for since in range(0, whole.num_rows, rows):
            batch = whole.slice(since, rows)
            words = [words_of(text) for text in batch.column(1).to_pylist()]
            codes = coded([word for of_text in words for word in of_text])
            cuts = np.cumsum([0] + [len(of_text) for of_text in words])
            runs = solve_all([codes[a:b] for a, b in zip(cuts, cuts[1:])])
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(np.diff(cuts), pa.int64()), pa.array([_as_structs(of_text) for of_text in runs], ARROW_RUNS),
                    pa.array([collapsed(of_text, found) for of_text, found in zip(words, runs)], pa.string()),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def tiles_of(n_words: int) -> Iterator[tuple[int, int, int]]:
    """(least period, start, end) of the tiles of a document."""
    size, least = TILE, 1
    while True:
        step = size - size // 4
        for start in range(0, max(n_words - size // 4, 1), step):
            yield least, start, min(start + size, n_words)
        if size >= n_words:  # one tile held all, so it was searched for all larger periods too
            return
        least = PERIODS if least == 1 else 2 * least
        size *= 2


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            codes = coded(words_of(text.as_py())).astype("<i4")
            for least, start, end in tiles_of(len(codes)):
                columns = [[row], [least], [start], [codes[start:end].tobytes()]]
                yield pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, TILE_TYPES)], names=["row", "least", "start", "codes"])


TILE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, least, begin, codes in zip(*(column.to_pylist() for column in batch.columns)):
            found = solve_all([np.frombuffer(codes, "<i4").astype(np.int64)], least)[0]
            starts, ends, periods = [begin + start for start, _, _ in found], [begin + end for _, end, _ in found], [period for _, _, period in found]
            yield pa.record_batch([pa.array(column, pa.int64()) for column in ([row] * len(found), periods, starts, ends)], names=["row", "period", "start", "end"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place in range(batch.num_rows):
            one = batch.slice(place, 1)
            words = words_of(one.column(1)[0].as_py())
            runs = [(run["start"], run["start"] + run["length"], run["period"]) for run in one.column(2)[0].as_py() or []]
            yield pa.record_batch(
                [one.column(0), pa.array([len(words)], pa.int64()), pa.array([_as_structs(runs)], ARROW_RUNS), pa.array([collapsed(words, runs)], pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, period, start, end) of whole runs from their fragments in overlapping tiles."""
    before = Window.partitionBy("row", "period").orderBy("start", "end")
    so_far = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > so_far - F.col("period"), F.lit(True)).cast("int")
    numbered = fragments.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "period", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nth")


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for each row of ``docs``, the id under its own name.

    ``runs`` are structs of start (word number from 0), length and period in words, by start and period: all maximal
    stretches of at least four of their smallest period and six words. ``collapsed`` is the text without the words that
    a run holds behind its first period, joined by single spaces.

    Null and empty texts have no words, no runs and an empty collapsed text. Null ids and repeated rows come back as
    they are, each with its own result. Texts of any length are searched whole: those of more than ``WHOLE_BYTES`` in
    tiles that are dealt over all tasks. Other columns are not read. An empty table gives an empty result.
    """
    require(docs, id_column, text_column)
    slim = docs.select(ref(id_column).alias("id"), F.coalesce(ref(text_column).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    result = f"id {kind}, n_words long, runs {RUNS}, collapsed string"
    fits = F.octet_length("text") <= WHOLE_BYTES
    short = arrow_map(slim.where(fits), _solve_whole, result)
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "long-texts")
    slim.where(~fits).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    long_ = spark.read.parquet(path)
    tiles = arrow_map(long_.select("row", "text"), _explode, "row long, least long, start long, codes binary")
    fragments = arrow_map(tiles.repartition("row", "least", "start"), _solve_tiles, "row long, period long, start long, end long")
    runs = stitched(cut_lineage(fragments)).groupBy("row").agg(
        F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")).alias("runs")
    )
    of_long = arrow_map(long_.join(runs, "row", "left").select("id", "text", "runs"), _collapse, result)
    return short.unionByName(of_long).withColumnRenamed("id", id_column)


def with_repeats(text: Column, first: Column, period: Column) -> Column:
    """``text`` whose words from number ``first`` on repeat the ``period`` words that begin there, up to as many words as
    before. ``text`` is a list of words; the result is a text with single spaces."""
    n = F.size(text)
    unit = F.slice(text, first + 1, period)
    times = F.ceil((n - first) / period).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - first)
    return F.array_join(F.concat(F.slice(text, F.lit(1), first), repeated), " ")
