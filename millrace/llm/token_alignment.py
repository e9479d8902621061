"""Tokens of two vocabularies aligned over the same bytes, and how often each pair of them meets in a corpus.

A batch of documents is a handful of Arrow columns, and every step works on all of them at once: token ids as one list
array for each tokenizer, flattened, with the parent of each token; byte ends as cumulative sums of token lengths that
begin anew with each document; a hash join of the two sides on (document, end), which leaves the places where both end;
the number of such places before a token, its group; and the pairs of tokens in each group. Where a side has one token,
it is paired with each of the other side. Groups with several on both sides go through a hash join on the group, with
tokens counted first, so a long group of few different tokens is a few pairs.

How many documents hold a pair is counted for each batch by ``Table.group_by``; Spark adds the batches' counts up, and
brings the totals back to the batches that have the pair. A common pair is so one row in a batch, never one in a document.
A batch's documents and its totals meet in one task, whose size is the batch's.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..schema import ref, require
from ..session import scratch_path
from .common import arrow_map, ship
from .token_counts import byte_letters

BATCH_BYTES, BATCH_DOCUMENTS = 1 << 20, 2_000
END_BITS = 36  # of a (document in the batch, byte) key
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"


class Content:
    """The bytes of each token of a vocabulary, behind each other."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(entry) for entry in entries], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ahead = np.cumsum(sizes) - sizes
        return self.all[np.repeat(self.begins[ids] - ahead, sizes) + np.arange(int(sizes.sum()))].tobytes()


class ByteLevel:
    """A space and the text, by a byte-level vocabulary; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {token["content"] for token in described["added_tokens"]}
        entries = {bytes(byte_of[letter] for letter in entry): number for entry, number in described["model"]["vocab"].items() if entry not in special}
        listed = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            listed[number] = entry
        self.content = Content(listed)
        #: ids ascend in the order of the merges, so they serve as ranks
        self.encoding = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + text) for text in texts]


class Pieces:
    """The text by a vocabulary of pieces that puts a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        listed = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            byte = BYTE_PIECE.fullmatch(piece) if self.model.is_byte(number) else None
            listed.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode())
        self.content = Content(listed)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=2)
def tokenizers_at(first: str, second: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(of_text) for of_text in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


class Side:
    """The tokens of one tokenizer in a batch: ids, document of each, byte end of each in its document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, content: Content):
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
        self.ids, self.sizes = lists.flatten(), sizes
        self.document = _numbers(pc.list_parent_indices(lists)).astype(np.int64)
        upto = _numbers(pc.cumulative_sum(pc.take(pa.array(content.sizes), self.ids))) if len(ids) else np.zeros(0, np.int64)
        ahead = np.concatenate(([0], upto))[offsets[:-1]]  # of the tokens before each document's first
        self.ends = upto - ahead[self.document]

    def by_end(self, place: str) -> pa.Table:
        return pa.table({"key": (self.document << END_BITS) | self.ends, place: np.arange(len(self.ends))})

    def cut(self, shared: np.ndarray) -> None:
        """Into groups behind the tokens at ``shared``; they are numbered over the whole batch."""
        last = np.sort(shared)
        self.of_group = np.concatenate(([0], last + 1)).astype(np.int32)  # the first token of each group, and the end
        flags = np.zeros(len(self.ends), np.int64)
        flags[last] = 1
        self.group = np.cumsum(flags) - flags

    def counted(self, chosen: np.ndarray, name: str) -> pa.Table:
        """(group, id, number) of the tokens in the groups that are chosen."""
        inside = chosen[self.group]
        table = pa.table({"group": self.group[inside], name: _numbers(self.ids)[inside].astype(np.int64), "n": np.ones(int(inside.sum()), np.int64)})
        return table.group_by(["group", name], use_threads=False).aggregate([("n", "sum")]).rename_columns(["group", name, f"n_{name}"])

    def written(self) -> pa.Array:
        """Ids of each group with commas between."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.of_group), pc.cast(self.ids, pa.string())), ",")


def _paired(a: Side, b: Side) -> pa.Table:
    """(group, a, b, n): the pairs of ids in each group and how often they are linked there."""
    ids_a, ids_b = _numbers(a.ids).astype(np.int64), _numbers(b.ids).astype(np.int64)
    n_a, n_b = np.diff(a.of_group), np.diff(b.of_group)
    several = (n_a > 1) & (n_b > 1)
    alone_a, alone_b = (n_a == 1)[b.group], ((n_a > 1) & (n_b == 1))[a.group]
    group = np.concatenate((b.group[alone_a], a.group[alone_b]))
    one_to_one = {
        "group": group, "a": np.concatenate((ids_a[a.of_group[b.group[alone_a]]], ids_a[alone_b])),
        "b": np.concatenate((ids_b[alone_a], ids_b[b.of_group[a.group[alone_b]]])), "n": np.ones(len(group), np.int64),
    }
    met = a.counted(several, "a").join(b.counted(several, "b"), "group", join_type="inner", use_threads=False)
    met = pa.table({"group": met["group"], "a": met["a"], "b": met["b"], "n": pc.multiply(met["n_a"], met["n_b"])})
    return pa.concat_tables([pa.table(one_to_one), met])


def align(texts: list[str], first: ByteLevel, second: Pieces) -> tuple[pa.Table, pa.Table, pa.Table]:
    """(documents, links, pairs) of a batch: for each text n_a, n_b, n_groups, n_links and the groups as a text; for each
    document and pair (its place among the pairs) that is linked in it the number of links, in the order of documents;
    for each pair of ids (a, b) the number of documents."""
    sides = []
    wanted = [(" " + text).encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    good = np.array([bool(text) for text in texts], bool)
    for tokenizer in (first, second):
        ids, sizes = _flat(tokenizer.ids(texts))
        cuts = np.concatenate(([0], np.cumsum(tokenizer.content.sizes[ids])))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        given = tokenizer.content.joined(ids)
        good &= np.array([given[begin:end] == text for begin, end, text in zip(cuts, cuts[1:], wanted)], bool)
        sides.append((ids, sizes, tokenizer.content))
    a, b = (Side(ids[np.repeat(good, sizes)], np.where(good, sizes, 0), content) for ids, sizes, content in sides)
    ends = a.by_end("place_a").join(b.by_end("place_b"), "key", join_type="inner", use_threads=False)
    a.cut(ends["place_a"].to_numpy())
    b.cut(ends["place_b"].to_numpy())
    owner = a.document[a.of_group[1:] - 1]
    n_groups = np.bincount(owner, minlength=len(texts))
    paired = _paired(a, b)
    codes = pc.dictionary_encode(pc.bit_wise_or(pc.shift_left(paired["a"], 32), paired["b"])).combine_chunks()
    links = pa.table({"document": owner[paired["group"].to_numpy()], "pair": codes.indices, "n": paired["n"]})
    links = links.group_by(["document", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["document", "pair", "n"])
    links = links.take(np.argsort(links["document"].to_numpy(), kind="stable"))
    held = links.group_by("pair", use_threads=False).aggregate([("n", "count")])
    n_documents = np.zeros(len(codes.dictionary), np.int64)
    n_documents[held["pair"].to_numpy()] = held["n_count"].to_numpy()
    pair = _numbers(codes.dictionary)
    pairs = pa.table({"a": (pair >> 32).astype(np.int32), "b": (pair & 0xFFFFFFFF).astype(np.int32), "n_documents": n_documents})
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, links["document"].to_numpy(), links["n"].to_numpy())
    of_group = pc.binary_join_element_wise(a.written(), b.written(), "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)), of_group), ";")
    return pa.table({"n_a": a.sizes, "n_b": b.sizes, "n_groups": n_groups, "n_links": n_links, "groups": groups}), links, pairs


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many documents and bytes, a document at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    since, held = 0, 0
    for place, size in enumerate(sizes.tolist()):
        if place > since and (held + size > BATCH_BYTES or place - since == BATCH_DOCUMENTS):
            yield batch.slice(since, place - since)
            since, held = place, 0
        held += size
    if since < batch.num_rows:
        yield batch.slice(since)


def _nested(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


FIRST_PASS = (
    "batch long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<int>, n array<long>, "
    "pair_a array<int>, pair_b array<int>, n_documents array<long>"
)


def _align_batches(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = tokenizers_at(first, second), TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in _slices(whole, 1):
                documents, links, pairs = align([text or "" for text in part.column(1).to_pylist()], *tokenizers)
                sizes = np.bincount(links["document"].to_numpy(), minlength=part.num_rows)
                hashes = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in documents["groups"].to_pylist()]
                columns = [documents[name].combine_chunks().cast(pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
                lists = [_nested(links["pair"].combine_chunks().cast(pa.int32()), sizes), _nested(links["n"].combine_chunks().cast(pa.int64()), sizes)]
                of_pairs = [pairs["a"].combine_chunks(), pairs["b"].combine_chunks(), pairs["n_documents"].combine_chunks().cast(pa.int64())]
                rows, names = part.num_rows, ["batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n", "pair_a", "pair_b", "n_documents"]
                none = [pa.nulls(rows, pa.list_(values.type)) for values in of_pairs]
                yield pa.record_batch([pa.array([number] * rows, pa.int64()), part.column(0), *columns, pa.array(hashes, pa.string()), *lists, *none], names=names)
                blank = [pa.nulls(1, column.type) for column in (part.column(0), *columns)]
                blank += [pa.nulls(1, pa.string()), *[pa.nulls(1, values.type) for values in lists]]
                yield pa.record_batch([pa.array([number], pa.int64()), *blank, *[_nested(values, np.array([len(values)])) for values in of_pairs]], names=names)
                number += 1

    return run


def _summed(documents: pa.Table, totals: pa.Table) -> pa.Table:
    """What the links of each document of a batch count, given the totals of the batch's pairs by their place."""
    order = np.argsort(totals["pair"].to_numpy())
    counts, best = totals["n_documents"].to_numpy()[order], totals["is_best"].to_numpy()[order]
    pair, n = documents["pair"].combine_chunks(), documents["n"].combine_chunks()
    parent, place, times = (values.to_numpy(zero_copy_only=False) for values in (pc.list_parent_indices(pair), pair.flatten(), n.flatten()))
    n_best, count_sum = np.zeros(documents.num_rows, np.int64), np.zeros(documents.num_rows, np.int64)
    np.add.at(count_sum, parent, times * counts[place])
    np.add.at(n_best, parent, times * best[place])
    kept = documents.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    for name, values in (("n_best", n_best), ("count_sum", count_sum)):
        kept = kept.append_column(name, pa.array(values))
    return kept.append_column("groups_sha256", documents["groups_sha256"])


def pair_totals(written: DataFrame) -> DataFrame:
    """(a, b, n_documents, is_best) of all pairs of the first pass: the number of documents that hold the pair linked,
    and whether no other pair of ``a`` has more."""
    total = _pairs(written).groupBy("a", "b").agg(F.sum("n_documents").alias("n_documents"))
    most = total.groupBy("a").agg(F.max("n_documents").alias("most"))
    return total.join(most, "a").select("a", "b", "n_documents", (F.col("n_documents") == F.col("most")).alias("is_best"))


def _pairs(written: DataFrame) -> DataFrame:
    each = F.posexplode(F.arrays_zip("pair_a", "pair_b", "n_documents")).alias("pair", "of")
    return written.where("pair_a IS NOT NULL").select("batch", each).select(
        "batch", "pair", F.col("of.pair_a").alias("a"), F.col("of.pair_b").alias("b"), F.col("of.n_documents").alias("n_documents")
    )


def first_pass(docs: DataFrame, first: str | None = None, second: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents aligned batch by batch, written once: a row for each document, with its links by their place among the
    batch's pairs, and one for each batch, with its pairs and how many of its documents hold them."""
    require(docs, id_column, text_column)
    slim = docs.select(ref(id_column).alias("id"), F.coalesce(ref(text_column).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    paths = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    path = scratch_path(docs.sparkSession, "alignment")
    arrow_map(slim, _align_batches(*paths), FIRST_PASS.format(kind=kind)).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    A is a byte-level vocabulary file over a space and the text, B a file of pieces over the text, to which it adds the
    space (``first``, ``second``: their paths on every worker; by default the public 50k and 32k ones). Byte offsets at
    which tokens of both end cut a document into groups; all tokens of A and B in one group are linked. The count of a
    pair of ids is the number of rows of the whole table that hold it linked; ``count_sum`` adds it up over the links,
    ``n_best`` counts the links whose pair no other pair of the same A id exceeds. ``groups_sha256`` is of the groups as
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those that the tokens of A or B do not give back byte for byte (as with a space mark in
    the text), have no tokens: zeros, and an empty string for the hash. Null ids and repeated rows come back as they are,
    each counted. Texts of any length are aligned whole. Other columns are not read. An empty table gives an empty result.
    """
    written = first_pass(docs, first, second, id_column, text_column)
    back = _pairs(written).drop("n_documents").join(pair_totals(written), ["a", "b"]).select(F.col("batch").alias("of"), "pair", "n_documents", "is_best")
    documents = written.where("n_a IS NOT NULL").drop("pair_a", "pair_b", "n_documents")
    ship(docs.sparkSession)
    kind = written.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(_summed, schema).withColumnRenamed("id", id_column)
