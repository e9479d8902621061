import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs as module
from millrace.llm.periodic_runs import collapsed, periodic_runs, solve_all, tiles_of, words_of
from millrace.llm.queries import op11_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All runs, period by period and word by word."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                stretch = words[i : j + q]
                if not any(all(a == b for a, b in zip(stretch, stretch[d:])) for d in range(1, q)):
                    found.append((i, j + q, q))
            i = max(j, i) + 1
    return sorted(found)


def plain_collapsed(words, runs):
    return " ".join(word for i, word in enumerate(words) if not any(start + q <= i < end for start, end, q in runs))


def made_of_repeats(seed, n):
    """Repeats within repeats, some broken by one word, some that share words with their neighbour."""
    generator = random.Random(seed)
    words = []
    while len(words) < n:
        unit = [generator.choice("abc") for _ in range(generator.choice([1, 1, 2, 3, 4, 6, 7, 12, 33]))]
        if generator.random() < 0.3:
            unit = unit * generator.randrange(1, 5) + [generator.choice("abx")]
        stretch = unit * generator.randrange(1, 9) + unit[: generator.randrange(len(unit))]
        if generator.random() < 0.3:
            stretch[generator.randrange(len(stretch))] = "z"
        words += stretch
    return words[:n]


@pytest.mark.parametrize("size", [0, 1, 5, 6, 7, 8, 30, 100, 400])
def test_against_every_period(size):
    texts = [made_of_repeats(seed, size) for seed in range(60 if size < 400 else 25)]
    codes = [np.array([ord(word) for word in words], np.int64) for words in texts]
    assert solve_all(codes) == [plain_runs(words) for words in texts]


def test_one_word_and_powers_only_give_their_smallest_period():
    for unit in (["a"], ["a", "b"], list("aabaab"), list("abcabd") * 2):
        words = unit * 64
        assert solve_all([np.array([ord(word) for word in words], np.int64)])[0] == plain_runs(words)


def test_tiles_cover_every_run():
    for n in (1, 64, 65, 300, 5_000):
        for least, start, end in tiles_of(n):
            assert 0 <= start < end <= n
        by_least = {}
        for least, start, end in tiles_of(n):
            by_least.setdefault(least, []).append((start, end))
        for spans in by_least.values():
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def results(df):
    return sorted(((row["doc_id"], row["n_words"], [(r["start"], r["start"] + r["length"], r["period"]) for r in row["runs"]], row["collapsed"]) for row in df.collect()), key=repr)


def wanted(rows):
    found = []
    for row in rows:
        words = WORDS.findall(row[1] or "")
        runs = plain_runs(words) if len(words) < 3_000 else []
        found.append((row[0], len(words), runs, plain_collapsed(words, runs)))
    return sorted(found, key=repr)


def test_odd_rows_and_no_rows(odd_docs, odd_rows, no_docs):
    assert results(periodic_runs(odd_docs)) == wanted(odd_rows)
    assert periodic_runs(no_docs).collect() == []


def test_texts_of_several_tiles(spark, monkeypatch):
    """Runs within a tile, across tiles of each octave, and through the whole text, with tiles of 64 words."""
    rows = [(seed, " ".join(made_of_repeats(seed, n))) for seed, n in enumerate([90, 150, 300, 700, 1_500] * 3)]
    rows += [(100, "a " * 900), (101, "a b " * 500), (102, " ".join(f"w{i % 100}" for i in range(900))), (103, " ".join(f"w{i}" for i in range(500)))]
    generator = random.Random(7)
    unit = [f"u{generator.randrange(9)}" for _ in range(111)]
    rows.append((104, " ".join(["x"] * 50 + unit * 4 + unit[:17] + ["y", "y"] * 20 + unit * 4)))
    #: what runs in the tasks is given the sizes along with it
    changed = {"TILE": 64, "PERIODS": 4, "WHOLE_BYTES": 128}
    for name, value in changed.items():
        monkeypatch.setattr(module, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tiles = [(row, tile) for row, (_, text) in enumerate(rows) for tile in tiles_of(len(text.split()))]
    fragments = []
    for row, (least, start, end) in tiles:
        codes = module.coded(words_of(rows[row][1])).astype(np.int64)[start:end]
        fragments += [(row, period, start + a, start + b) for a, b, period in solve_all([codes], least)[0]]
    whole = module.stitched(spark.createDataFrame(fragments, "row long, period long, start long, end long")).collect()
    found = [sorted((r["start"], r["end"], r["period"]) for r in whole if r["row"] == row) for row in range(len(rows))]
    assert found == [plain_runs(text.split()) for _, text in rows]
    monkeypatch.undo()
    assert results(periodic_runs(docs)) == wanted(rows)


def test_long_texts_go_through_tiles(spark):
    unit = [f"v{i}" for i in range(1_300)]
    long_ = " ".join(unit * 5 + ["a", "b"] * 3_000 + [f"t{i}" for i in range(4_000)] + ["c"] * 5_000 + unit[:600] * 4)
    rows = {row["doc_id"]: row for row in periodic_runs(spark.createDataFrame([(1, long_), (2, long_), (None, long_)], "doc_id long, text string")).collect()}
    expected = [(0, 6_500, 1_300), (6_500, 6_000, 2), (16_500, 5_000, 1), (21_500, 2_400, 600)]
    assert len(rows) == 3
    for row in rows.values():
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == expected
        assert row["collapsed"] == collapsed(words_of(long_), [(start, start + length, q) for start, length, q in expected])


def test_query_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in rows:
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda run: (run[1] - run[0], -run[0], -run[2]), default=None)
        lines = "".join(f"{start},{end - start},{q}\n" for start, end, q in runs)
        expected[doc_id] = (
            len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
        )
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = {row["doc_id"]: tuple(row[name] for name in names) for row in op11_periodic_runs(spark, folder).collect()}
    assert found == expected
    assert sum(1 for value in expected.values() if value[0]) > 5
