import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import pieces  # noqa: E402
from millrace.llm.pieces import cut as pieces_of  # noqa: E402
from millrace.llm.token_counts import Merges, token_counts  # noqa: E402
from millrace.llm.token_files import Encoder, TokenFile, read_digests, write_token_files  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "<|endoftext|>", "ß", "漢字", "\xa0", " ", "\x1c", "\x85", "!", "...", "aaaa", "\r\n", "😀", "​", "_", "the", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    generator = random.Random(5)
    return ["".join(generator.choice(PARTS) for _ in range(generator.randrange(40))) for _ in range(n)] + ["a" * 3_000, "ab" * 2_000, " " * 500, "", None, "\n", "x\n"]


def ids_of(library, texts):
    return [np.array(found.ids, "<u4") for found in library.encode_batch([text or "" for text in texts], add_special_tokens=False)]


@pytest.mark.parametrize("remembered", [1_000_000, 50])
def test_counts_and_ids_of_odd_texts(library, monkeypatch, remembered):
    monkeypatch.setattr(pieces, "PIECES_REMEMBERED", remembered)
    monkeypatch.setattr("millrace.llm.token_files.PIECES_REMEMBERED", remembered)
    texts = odd_texts(1_500)
    wanted = ids_of(library, texts)
    merges, encoder = Merges(PATH), Encoder(PATH)
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        assert merges.counts(part) == [len(ids) for ids in wanted[start : start + 100]]
        assert encoder.encode(part) == [ids.tobytes() for ids in wanted[start : start + 100]]


def strange_texts(n):
    """Characters of all kinds, among them every ASCII one and all white space, beside words."""
    generator = random.Random(8)
    spaces = [chr(code) for code in [*range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    blocks = [(0, 0x80), (0xA0, 0x300), (0x300, 0x800), (0x800, 0xD800), (0xE000, 0x10000), (0x10000, 0x1FFFF)]
    kinds = [lambda: chr(generator.randrange(*generator.choice(blocks))), lambda: chr(generator.randrange(128)), lambda: generator.choice(spaces), lambda: generator.choice(PARTS + ["'s", "'", " ", "\n"])]
    return ["".join(generator.choice(kinds)() for _ in range(generator.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [1_000_000, 50])
def test_ids_of_strange_texts(library, monkeypatch, remembered):
    monkeypatch.setattr("millrace.llm.token_files.PIECES_REMEMBERED", remembered)
    texts, encoder = strange_texts(6_000), Encoder(PATH)
    for start in range(0, len(texts), 1_000):
        part = texts[start : start + 1_000]
        assert encoder.encode(part) == [ids.tobytes() for ids in ids_of(library, part)]


def test_a_column_is_cut_where_pre_tokens_end():
    texts = pa.array(["left out", "Thé, (word) x12!\n\n Ein\nZ'sa", "", " \t", "漢字 б, 2\u3000 a\xa0 b× c” ế か d", "a"])
    pieces, first = pieces_of(texts[1:])
    assert first.tolist() == [0, 12, 12, 13, 20, 21]
    lines = ["Thé", ",", " (", "word", ")", " x", "12", "!", "\n\n Ein", "\n", "Z", "'sa"]
    assert pieces.to_pylist() == [*lines, " \t", "漢字", " б,", " 2\u3000 a\xa0 b×", " c”", " ế", " か", " d", "a"]
    assert "".join(pieces.to_pylist()) == "".join(texts[1:].to_pylist())


def test_a_column_of_any_layout_is_encoded(library):
    texts = ["before", "one, two", None, "", "a<|endoftext|> b", "after"]
    wanted = [ids.tobytes() for ids in ids_of(library, texts)]
    encoder = Encoder(PATH)
    for kind in (pa.string(), pa.large_string()):
        assert list(encoder.encode_column(pa.array(texts, kind)[1:5])) == wanted[1:5]
        assert list(encoder.encode_column(pa.array([None, ""], kind))) == [b"", b""]
        assert list(encoder.encode_column(pa.array([], kind))) == []


def test_frequent_words_are_asked_once_however_many_rare_ones_pass(monkeypatch):
    monkeypatch.setattr(pieces, "PIECES_REMEMBERED", 200)
    monkeypatch.setattr("millrace.llm.token_files.PIECES_REMEMBERED", 200)
    encoder, asked = Encoder(PATH), []

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, text, **options):
            asked.append(text)
            return self.tokenizer.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched(encoder.tokenizer)
    for number in range(50):
        encoder.encode([f"go frequent {' '.join(f'rare{chr(97 + number % 26)}{chr(97 + number // 26)}{chr(97 + i)}' for i in range(20))}, frequent. frequent"])
    assert sum(text.count("frequent") for text in asked) == 1


def test_token_counts(spark, odd_docs, odd_rows, no_docs, library):
    result = token_counts(odd_docs, limit=100)
    wanted = sorted(((row[0], len((row[1] or "").encode()), len(ids), len(ids) > 100) for row, ids in zip(odd_rows, ids_of(library, [row[1] for row in odd_rows]))), key=repr)
    assert sorted(map(tuple, result.collect()), key=repr) == wanted
    assert token_counts(no_docs).collect() == []


def test_token_files(spark, odd_docs, odd_rows, no_docs, library):
    manifest = write_token_files(odd_docs, end=2, files=4)
    ordered = sorted(odd_rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or ""))
    contents = [np.append(ids, np.uint32(2)).astype("<u4") for ids in ids_of(library, [row[1] for row in ordered])]
    starts = np.cumsum([0] + [len(ids) for ids in contents])[:-1]
    wanted = sorted(((row[0], int(start), len(ids), zlib.crc32(ids.tobytes())) for row, start, ids in zip(ordered, starts, contents)), key=repr)
    assert sorted(map(tuple, read_digests(manifest).collect()), key=repr) == wanted
    assert read_digests(write_token_files(no_docs, end=2)).collect() == []


def test_only_wanted_frames_are_read_and_damage_is_seen(spark, odd_docs, library):
    manifest = write_token_files(odd_docs.where("doc_id < 9"), end=2, files=1)
    path = manifest.first()["path"].removeprefix("file:")
    file = TokenFile(path)
    read = []
    unpack = file.ids
    file.ids = lambda place: read.append(place) or unpack(place)
    (key, ids), = file.wanted([3])
    assert key == 3 and len(read) == 1
    assert ids.tolist() == [*library.encode("one", add_special_tokens=False).ids, 2]
    with open(path, "r+b") as raw:
        raw.seek(int(file.ends[3]) - 1)
        last = raw.read(1)
        raw.seek(-1, 1)
        raw.write(bytes([last[0] ^ 1]))
    with pytest.raises(Exception):
        TokenFile(path).ids(3)
