"""Token counts by rank-synchronous merging of batched pre-tokens in numpy arrays.

All distinct new pre-tokens of a batch lie behind each other in one ragged array of symbols. In each step every
sequence finds its own lowest-rank pair and all its occurrences are merged, in all sequences at once; a sequence
without a pair left leaves the array, and its number of symbols is its number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import ref, require
from .common import arrow_map
from .pieces import PieceMemory, pre_tokens

DOCUMENTS_AT_ONCE = 256
SLOT_BITS = 18  # five times the slots that 50,000 merges fill
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is printable
    Latin-1, otherwise the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return [chr(byte) if byte in set(shown) else chr(256 + hidden.index(byte)) for byte in range(256)]


class Merges:
    """The ranked merges of a byte-level vocabulary, and counts already made with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        merges = [tuple(merge) if isinstance(merge, list) else tuple(merge.split(" ")) for merge in described["model"]["merges"]]
        pairs = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], np.int64)
        self.slots, self.slot_rank = self._table(pairs)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.first = np.array([vocabulary[letter] for letter in byte_letters()], np.int64)
        self.specials = [token["content"] for token in described["added_tokens"]]
        self.memory = PieceMemory(self.learn)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.intp)

    def _table(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressing table of the pairs: the pair in each slot (-1: none) and its rank."""
        slots = np.full(1 << SLOT_BITS, -1, np.int64)
        ranks = np.full(1 << SLOT_BITS, NO_RANK, np.int32)
        left, at = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = slots[at] == -1
            slots[at[free]] = pairs[left[free]]  # of several for one slot the last stays
            placed = slots[at] == pairs[left]
            ranks[at[placed]] = left[placed]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << SLOT_BITS) - 1)
        return slots, ranks

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = self._slot(wanted)
        held = self.slots[at]
        found = np.where(held == wanted, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((held != wanted) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << SLOT_BITS) - 1)
            held = self.slots[at[open_]]
            match = held == wanted[open_]
            found[open_[match]] = self.slot_rank[at[open_[match]]]
            open_ = open_[~match & (held != -1)]
        return found

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that are left of each pre-token."""
        sizes = np.array([len(token) for token in tokens], np.int64)
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        result = np.zeros(len(tokens), np.int64)
        owner = np.arange(len(tokens))
        while len(symbols):
            ends = np.cumsum(sizes)
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NO_RANK
            lowest = np.minimum.reduceat(ranks, ends - sizes)
            ripe = lowest != NO_RANK
            result[owner[~ripe]] = sizes[~ripe]
            hit = (ranks == np.repeat(lowest, sizes)) & (ranks != NO_RANK)
            places = np.arange(len(symbols))
            begins = hit & ~np.concatenate(([False], hit[:-1]))
            since = places - np.maximum.accumulate(np.where(begins, places, 0))
            hit &= since % 2 == 0  # of three equal symbols the first two merge
            symbols[hit] = self.merged[ranks[hit]]
            stays = np.repeat(ripe, sizes)
            stays[1:] &= ~hit[:-1]
            left = np.add.reduceat(stays, ends - sizes, dtype=np.int64)
            symbols, sizes, owner = symbols[stays], left[ripe], owner[ripe]
        return result

    def learn(self, pieces: list[str], space: str) -> list[int]:
        split = [pre_tokens(piece, space) for piece in pieces]
        tokens = list({token for parts in split for token in parts})
        counts = dict(zip(tokens, self.lengths([token.encode() for token in tokens]).tolist()))
        return [counts[parts[0]] if len(parts) == 1 else sum(map(counts.__getitem__, parts)) for parts in split]

    def counts(self, texts: list[str | None]) -> list[int]:
        parts, owners, found = [], [], [0] * len(texts)
        for place, text in enumerate(texts):
            segments = [text or ""]
            for special in self.specials:
                segments = [piece for segment in segments for piece in segment.split(special)]
            found[place] = len(segments) - 1
            parts += segments
            owners += [place] * len(segments)
        for place, lines in zip(owners, self.memory.lines_of(parts)):
            found[place] += max(len(lines) - 1, 0) + sum(head + sum(tail) for head, tail in lines)
        return found


@lru_cache(maxsize=2)
def merges_at(path: str) -> Merges:
    return Merges(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_at(path)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(start, DOCUMENTS_AT_ONCE)
                counts = merges.counts(batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, limit: int = 1024, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, the id under its own name.

    Tokens are those of a byte-level vocabulary file with ranked merges (``vocabulary``: its path on every worker; by
    default the public 50k one), without begin or end tokens; a special token's string in a text is that token.
    Null and empty texts have no bytes and no tokens; null ids and repeated rows come back as they are. Other
    columns are not read. Texts of any length are counted whole.
    """
    require(docs, id_column, text_column)
    text = F.coalesce(ref(text_column).cast("string"), F.lit(""))
    slim = docs.select(ref(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = slim.schema["id"].dataType.simpleString()
    found = arrow_map(slim, _count(vocabulary or public_tokenizers.path("byte_bpe_50k.json")), f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
