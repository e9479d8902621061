"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment of what they hit.

1. Words of all test items are counted over the whole corpus. A seed, a run of ``SEED`` words of an item, is rare when
   its words are so infrequent that less than ``CHANCE`` occurrences by chance would be expected in a corpus of this
   size. Rarity is not the seed's own count: a leak in a third of all documents does not make its seeds common. An
   item without a rare seed is sought by all its seeds, so none is left out.
2. Training passages are joined to items by seed, in one pass over the texts for each block of items; a block is a
   few megabytes and is sent to every task.
3. Around the hits of a document and an item the passage is aligned with the whole item. The best local score, in
   shares of the item's own, decides: edited, shortened and reworded copies lose points for the words they changed.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import ref, require
from ..session import cut_lineage
from .common import arrow_map

SEED = 4
CHANCE = 1.0
LEAST_WORDS = 8  # of an item; a shorter one says nothing about a document that holds it
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 4_000_000  # of item texts that are sent to the tasks at once
ALIGNMENTS_REMEMBERED = 20_000  # by a task: copies of a passage are aligned once

#: Punctuation is no part of a word here: ASCII letters in lower case, other ASCII signs as spaces. Texts with other
#: signs are case-folded by Unicode before, and Unicode punctuation, symbols, spaces and controls become spaces.
PLAIN = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte > 127 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32 for byte in range(256)
)


@cache
def _separators() -> frozenset[str]:
    signs = map(chr, range(128, sys.maxunicode + 1))
    return frozenset(sign for sign in signs if (kind := unicodedata.category(sign))[0] in "PSZ" or kind == "Cc")


def plain_words(text: bytes | None) -> list[bytes]:
    if text and not text.isascii():
        folded = text.decode(errors="surrogateescape").casefold()
        for sign in _separators().intersection(folded):
            folded = folded.replace(sign, " ")
        text = folded.encode(errors="surrogateescape")
    return text.translate(PLAIN).split() if text else []


class Items:
    """Test items as word numbers, and their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words = [plain_words(text.encode()) if text else [] for _, text in items]
        chosen = [place for place, found in enumerate(words) if len(found) >= LEAST_WORDS]
        self.ids = [items[place][0] for place in chosen]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [
            np.array([self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words[place]], np.int64) for place in chosen
        ]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The text's words as numbers, -1 for words that no item has."""
        words = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def choose_seeds(self, counts: np.ndarray, total: int) -> None:
        share = np.log(np.maximum(counts, 1) / max(total, 1))
        for item, words in enumerate(self.words):
            runs = np.lib.stride_tricks.sliding_window_view(words, SEED)
            rare = share[runs].sum(axis=1) + np.log(max(total, 1)) < np.log(CHANCE)
            for place in np.flatnonzero(rare) if rare.any() else range(len(runs)):
                self.seeds.setdefault(runs[place].tobytes(), []).append((item, int(place)))


def seed_hits(items: Items, numbers: np.ndarray) -> dict[int, list[int]]:
    """Item -> offsets (place in the text less place in the item) of its seeds in the text, ascending."""
    known = numbers >= 0
    if len(numbers) < SEED or not known.any():
        return {}
    full = np.convolve(known, np.ones(SEED, int), "valid") == SEED
    found: dict[int, list[int]] = {}
    for at in np.flatnonzero(full):
        for item, place in items.seeds.get(numbers[at : at + SEED].tobytes(), ()):
            found.setdefault(item, []).append(int(at) - place)
    return found


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local score, end in the passage) of Smith-Waterman with linear gaps, a row at a time."""
    steps = -GAP * np.arange(1, len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        above[1:] = np.maximum.accumulate(row + steps) - steps  # gaps in the item: the best of all cells to the left
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def best_alignment(numbers: np.ndarray, offsets: list[int], item: np.ndarray, remembered: dict) -> tuple[float, int, int]:
    """(share of the item's own score, first word, word behind the last) of the best passage near the offsets."""
    margin = len(item) // 4 + SEED
    best = (0.0, 0, 0)
    offsets = sorted(set(offsets))
    start = 0
    for stop in range(1, len(offsets) + 1):
        if stop < len(offsets) and offsets[stop] - offsets[stop - 1] <= len(item):
            continue
        low, high = max(0, offsets[start] - margin), min(len(numbers), offsets[stop - 1] + len(item) + margin)
        passage = numbers[low:high]
        key = (passage.tobytes(), item.tobytes())
        if key not in remembered:
            if len(remembered) >= ALIGNMENTS_REMEMBERED:
                remembered.clear()
            score, end = align(passage, item)
            _, back = align(passage[:end][::-1], item[::-1])
            remembered[key] = (score / (MATCH * len(item)), end - back, end)
        share, first, last = remembered[key]
        if share > best[0]:
            best = (share, low + first, low + last)
        start = stop
    return best


def _word_counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(items.vocabulary) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                numbers = items.numbers(text)
                counts += np.bincount(numbers + 1, minlength=len(counts))
                total += len(numbers)
        met = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(met.astype(np.int64) - 1), pa.array(counts[met])], names=["word", "n"])

    return run


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_BYTES``; one block is on the driver at a time."""
    require(benchmark, id_column, text_column)
    rows = benchmark.select(ref(id_column).cast("long").alias("id"), ref(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    rows = cut_lineage(rows)
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        items = Items([(row["id"], row["text"]) for row in chosen])
        if items.ids:
            yield items


def _with_seeds(items: Items, texts: DataFrame) -> Items:
    counted = arrow_map(texts, _word_counts(items), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(len(items.vocabulary), np.int64), 0
    for row in counted.collect():  # at most the words of one block
        total += row["n"]
        if row["word"] >= 0:
            counts[row["word"]] = row["n"]
    items.choose_seeds(counts, total)
    return items


def _scored(items: Items, least: float, text: bytes | None, remembered: dict) -> Iterator[tuple]:
    numbers = items.numbers(text)
    for item, offsets in seed_hits(items, numbers).items():
        share, first, last = best_alignment(numbers, offsets, items.words[item], remembered)
        if share >= least:
            yield items.ids[item], share, first, last, len(offsets)


def _report(items: Items, least: float):
    names = ["id", "item_id", "score", "first_word", "last_word", "n_seeds"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict = {}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows += [dict(zip(names, (key, *found))) for found in _scored(items, least, text, remembered)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _clean(items: Items, least: float, text_place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict = {}
        for batch in batches:
            texts = batch.column(text_place).cast(pa.binary()).to_pylist()
            mask = [next(_scored(items, least, text, remembered), None) is None for text in texts]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """(id, item_id, score, first_word, last_word, n_seeds): a row for each row of ``docs`` and test item of which it
    holds a copy that scores ``least`` of the item's own alignment score or more, with the span of words it covers.

    Words are case-folded by Unicode; punctuation, symbols and spaces, ASCII or not, separate them. Null and
    empty texts hold nothing; items with fewer than ``LEAST_WORDS`` words are not sought. Null ids come back null;
    repeated rows and repeated items give a row each. Other columns are not read. Empty tables give an empty result.
    """
    require(docs, id_column, text_column)
    slim = docs.select(ref(id_column).cast("long").alias("id"), ref(text_column).cast("string").alias("text"))
    schema = f"`{id_column}` long, item_id long, score double, first_word long, last_word long, n_seeds long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id_column, item_text_column):
        found = found.unionByName(arrow_map(slim, _report(_with_seeds(items, slim.select("text")), least), schema))
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.5, text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item as :func:`contaminated` finds them, all columns as they are."""
    require(docs, text_column)
    place = docs.columns.index(text_column)
    texts = docs.select(ref(text_column).cast("string").alias("text"))
    for items in _blocks(benchmark, item_id_column, item_text_column):
        docs = arrow_map(docs, _clean(_with_seeds(items, texts), least, place), docs.schema)
    return docs
