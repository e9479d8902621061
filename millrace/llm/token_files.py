"""Token ids in binary files of independent zstandard frames, one frame for a document.

A file is, in this order:

* a zstandard frame for each document, holding its ids as little-endian unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A50) with each document's id as a signed 64-bit integer and one byte that is 1
  where the id is null;
* a skippable frame (magic 0x184D2A5E) that is the seek table of the public seekable format: for each frame its
  compressed size, its size when decompressed and the low 32 bits of the XXH64 of its content; then the number of
  frames, a byte of flags, and the magic 0x8F92EAB1.

All numbers are little-endian. Plain zstandard readers skip the two last frames. A reader takes the tables from the
end of a file and decompresses only frames of documents it wants.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ref, require
from ..session import scratch_path
from .common import arrow_map
from .pieces import PIECES_REMEMBERED, RecentValues, cut
from .storage import new_file, store_of

#: Fixed values of the formats.
SKIPPABLE, SEEK_TABLE, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

BYTES_AT_ONCE = 8 << 20  # of texts, or one document
WORDS_AT_ONCE = 2_000  # that the library gets as one text
MANIFEST = "path string, first long, first_null boolean, n_docs long, n_ids long"


class Encoder:
    """Ids of whole texts as bytes, from the tokenizers library; ids of pieces met of late are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {token.content: np.uint32(number).tobytes() for number, token in added.items()}
        entries = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(entries.values()) + 1, np.int64)  # in bytes, for which one letter stands each
        self.sizes[list(entries.values())] = list(map(len, entries))
        self.sizes[list(added)] = 0
        self.memory = RecentValues(self._learn, PIECES_REMEMBERED)

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(found.ids, "<u4").tobytes() for found in encoded]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that are a space and letters: as one text, which the library cuts into them again. Where a
        word ends is told by the sizes of tokens."""
        content = self._ids(["".join(words)])[0]
        ends = np.cumsum(self.sizes[np.frombuffer(content, "<u4")])
        wanted = np.cumsum([len(word.encode()) for word in words])
        last = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return self._ids(words)
        cuts = [0, *(4 * last + 4).tolist()]
        return [content[start:stop] for start, stop in zip(cuts, cuts[1:])]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        words = [piece for piece in pieces if piece[0] == " " and piece[1:].isalpha()]
        others = list(set(pieces).difference(words))
        known = dict(zip(others, self._ids(others)))
        for start in range(0, len(words), WORDS_AT_ONCE):
            chosen = words[start : start + WORDS_AT_ONCE]
            known.update(zip(chosen, self._words(chosen)))
        return [known[piece] for piece in pieces]

    def _segments(self, text: str) -> list[tuple[str, bytes]]:
        """Stretches of ordinary text, each with the special token behind it (none behind the last)."""
        segments = [(text, b"")]
        for special, number in self.specials.items():
            split = []
            for part, after in segments:
                parts = part.split(special)
                split += [(piece, number) for piece in parts[:-1]] + [(parts[-1], after)]
            segments = split
        return segments

    def _ordinary(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text; none holds a special token."""
        pieces, first = cut(texts)
        coded = pieces.dictionary_encode()
        values = self.memory.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array(values, pa.large_binary()).take(coded.indices)
        content, places = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)
        ends = places[first].tolist()
        return (bytes(content[start:stop]) for start, stop in zip(ends, ends[1:]))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, none for a null."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not any(pc.any(pc.match_substring(texts, special)).as_py() for special in self.specials):
            return self._ordinary(texts)
        split = [self._segments(text) for text in texts.to_pylist()]
        ids = self._ordinary(pa.array([part for segments in split for part, _ in segments], pa.string()))
        return (b"".join([next(ids) + after for _, after in segments]) for segments in split)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.string())))


@lru_cache(maxsize=2)
def encoder_at(path: str) -> Encoder:
    return Encoder(path)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def tables_of(keys: list[int | None], frames: list[tuple[int, int, int]]) -> bytes:
    """What stands behind the frames of a file."""
    names = np.array([key or 0 for key in keys], "<i8").tobytes() + bytes(key is None for key in keys)
    seek = np.array(frames, FRAME).tobytes() + struct.pack("<IBI", len(frames), HAS_CHECKSUMS, SEEK_MAGIC)
    return _skippable(SKIPPABLE, names) + _skippable(SEEK_TABLE, seek)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts begin within so many bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // BYTES_AT_ONCE
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return (batch.slice(start, stop - start) for start, stop in zip(starts, [*starts[1:], batch.num_rows]))


def _write(folder: str, vocabulary: str, end: int):
    """One file for a task; its rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_at(vocabulary), zstandard.ZstdCompressor(level=1)
        last = np.uint32(end).tobytes()
        keys, frames, total, file = [], [], 0, None
        for whole in batches:
            for batch in _slices(whole):
                if file is None:
                    path, store, inside = new_file(folder, ".ids.zst")
                    file = store.open_output_stream(inside, compression=None)
                keys += batch.column(0).to_pylist()
                for ids in encoder.encode_column(batch.column(1)):
                    ids += last
                    packed = packer.compress(ids)
                    file.write(packed)
                    frames.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
                    total += len(ids) // 4
        if file is not None:
            file.write(tables_of(keys, frames))
            file.close()
            told = {"path": path, "first": keys[0], "first_null": keys[0] is None, "n_docs": len(keys), "n_ids": total}
            yield pa.RecordBatch.from_pylist([told], pa.schema([("path", pa.string()), ("first", pa.int64()), ("first_null", pa.bool_()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_token_files(
    docs: DataFrame, end: int, folder: str | None = None, vocabulary: str | None = None,
    id_column: str = "doc_id", text_column: str = "text", files: int | None = None,
) -> DataFrame:
    """Encode whole texts, append ``end`` to each, and write them in ascending order of the id (null first) to
    ``files`` files (as many as there are shuffle partitions). Returns the manifest, one row for a file in the order
    of its documents: path, number, n_docs, n_ids, start (ids in the files before).

    Null and empty texts are the end id alone; rows that repeat an id stand next to each other, ordered by their
    text. An empty table gives no file. Other columns are not read. ``folder`` defaults to a new one under
    ``spark.checkpoint.dir``; nothing is overwritten.
    """
    require(docs, id_column, text_column)
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(ref(id_column).cast("long").alias("id"), ref(text_column).cast("string").alias("text"))
    texts = texts.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    written = arrow_map(texts, _write(f"{folder}/files", vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end), MANIFEST)
    written.write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    order = Window.orderBy(F.col("first_null").desc(), "first")  # a row for each file, as many as there were tasks
    return manifest.select(
        "path", F.row_number().over(order).alias("number"), "n_docs", "n_ids",
        (F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("start"),
    )


class TokenFile:
    """A file opened for reading: ``keys`` are its documents' ids, ``ids(place)`` decompresses one document."""

    def __init__(self, path: str):
        store, inside = store_of(path)
        self.file = store.open_input_file(inside)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path}: no seek table")
        begin = size - 9 - count * FRAME.itemsize
        self.frames = np.frombuffer(self._at(begin, count * FRAME.itemsize), FRAME)
        names = begin - 8 - count * 9
        table = self._at(names, count * 9)
        nulls = table[count * 8 :]
        self.keys = [None if null else key for key, null in zip(np.frombuffer(table, "<i8", count).tolist(), nulls)]
        self.ends = np.cumsum(self.frames["packed"], dtype=np.int64)
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place)

    def ids(self, place: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.frames[place])
        content = self.unpacker.decompress(self._at(int(self.ends[place]) - packed, packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {place} is damaged")
        return np.frombuffer(content, "<u4")

    def wanted(self, keys: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents with these ids; no other frame is read."""
        chosen = set(keys)
        return ((key, self.ids(place)) for place, key in enumerate(self.keys) if key in chosen)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(path)
            contents = (file.ids(place) for place in range(len(file.keys)))
            sums = [(len(ids), zlib.crc32(ids.tobytes())) for ids in contents]
            lengths = np.array([length for length, _ in sums], np.int64)
            yield pa.record_batch(
                [pa.array(file.keys, pa.int64()), pa.array(start + np.cumsum(lengths) - lengths), pa.array(lengths),
                 pa.array([check for _, check in sums], pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts the ids of all documents
    before it, ``ids_crc32`` is over its ids as little-endian unsigned 32-bit integers. Frames with a wrong checksum
    raise."""
    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return arrow_map(files, _digests, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")
