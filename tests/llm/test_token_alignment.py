import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import token_alignment as module  # noqa: E402
from millrace.llm.queries import op12_alignment  # noqa: E402
from millrace.llm.token_alignment import aligned, first_pass, pair_totals  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "<|endoftext|>", "<s>", "<0x41>", "ß", "漢字", "\xa0", "!", "...", "aaaa", "\r\n", "😀", "_", "the", " the", "unbelievable ", "▁", "x" * 9, "\x1c", "\x85", "\u200b", "\u3000", "ſ", "'LL", "٣", " word", " other"]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_tokens(libraries, text):
    """[(id, bytes)] of A and of B; empty where they do not give the text back."""
    first, second = libraries
    letters = module.byte_letters()
    if not text:
        return [], []
    a = [(i, bytes(letters.index(c) for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    return (a, b) if all(b"".join(content for _, content in side) == wanted for side in (a, b)) else ([], [])


def plain(libraries, rows):
    per_row, counts = [], Counter()
    for _, text in rows:
        a, b = plain_tokens(libraries, text)
        groups, i, j, end_a, end_b = [], 0, 0, 0, 0
        while i < len(a):
            left, right = [a[i][0]], [b[j][0]]
            end_a, end_b = end_a + len(a[i][1]), end_b + len(b[j][1])
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    left.append(a[i][0])
                    end_a += len(a[i][1])
                else:
                    j += 1
                    right.append(b[j][0])
                    end_b += len(b[j][1])
            i, j = i + 1, j + 1
            groups.append((left, right))
        links = [(x, y) for left, right in groups for x in left for y in right]
        per_row.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    result = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, per_row):
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        result.append(
            (doc_id, n_a, n_b, len(groups), len(links), sum(counts[link] == best[link[0]] for link in links), sum(counts[link] for link in links),
             hashlib.sha256(said.encode()).hexdigest() if said else "")
        )
    return sorted(result, key=repr), counts


def results(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


def made(n, seed=5):
    generator = random.Random(seed)
    texts = ["".join(generator.choice(PARTS) for _ in range(generator.randrange(40))) for _ in range(n)]
    return list(enumerate(texts + ["a" * 3_000, "ab" * 2_000, " " * 500, "", None, "\n", " lead", "trail ", "ÀÉÎ çedilla 漢字 😀 " * 20]))


def test_made_texts(spark, libraries):
    rows = made(400)
    result, counts = plain(libraries, rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert results(aligned(docs)) == result
    totals = {(row["a"], row["b"]): row["n_documents"] for row in pair_totals(first_pass(docs)).collect()}
    assert totals == dict(counts)


@pytest.mark.parametrize("bytes_, documents", [(1, 1), (300, 7), (1 << 20, 50)])
def test_batches_do_not_change_what_is_found(monkeypatch, libraries, bytes_, documents):
    monkeypatch.setattr(module, "BATCH_BYTES", bytes_)
    monkeypatch.setattr(module, "BATCH_DOCUMENTS", documents)
    import pyarrow as pa

    rows = made(120, seed=8)
    first, second = module.ByteLevel(PATHS[0]), module.Pieces(PATHS[1])
    found, counts = [], Counter()
    for part in module._slices(pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["id", "text"]), 1):
        tables = module.align([text or "" for text in part.column(1).to_pylist()], first, second)
        found += zip(*(tables[0][name].to_pylist() for name in ("n_a", "n_b", "n_groups", "n_links")))
        assert tables[1]["document"].to_pylist() == sorted(tables[1]["document"].to_pylist())
        for row in tables[2].to_pylist():
            counts[row["a"], row["b"]] += row["n_documents"]
    result, wanted = plain(libraries, rows)
    assert sorted((i, *row) for i, row in enumerate(found)) == sorted(row[:5] for row in result)
    assert counts == wanted


def test_odd_rows_and_no_rows(odd_docs, odd_rows, no_docs, libraries):
    assert results(aligned(odd_docs)) == plain(libraries, [(row[0], row[1]) for row in odd_rows])[0]
    assert aligned(no_docs).collect() == []


def test_a_pair_in_every_document(spark, libraries):
    rows = [(i, "the same words " * 3 + str(i)) for i in range(3_000)]
    assert results(aligned(spark.createDataFrame(rows, SCHEMA))) == plain(libraries, rows)[0]


def test_query_against_plain_version(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert results(op12_alignment(spark, folder)) == plain(libraries, rows)[0]
