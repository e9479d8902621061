import random

import numpy as np
import pytest
from conftest import edited, prose

from millrace.llm import near_dup
from millrace.llm.fingerprints import band_keys, shingle_set, signature
from millrace.llm.graph import connected_components
from millrace.llm.near_dup import drop_near_duplicates, links_within, near_duplicates


def brute_components(rows, size, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").replace("\t", " ").replace("\n", " ").lower().split(" ")
        words = [word for word in words if word]
        length = min(size, len(words))
        sets.append({tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= percent * (len(one) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    smallest = {r: min((key for key in keys if key is not None), default=None) for r, keys in groups.items()}
    return sorted(((key, len(sets[i]), smallest[root(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_odd_rows(spark, odd_docs, odd_rows, size):
    result = near_duplicates(odd_docs, shingle=size)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(result) == brute_components([row[:2] for row in odd_rows], size)
    for row in result.collect():
        assert row["kept"] == (row["doc_id"] is None or row["doc_id"] == row["component_id"])


def test_families_near_the_threshold(spark, monkeypatch):
    """Copies of one text with so many edits that some are linked through others only, in several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    generator, rows = random.Random(3), []
    for family in range(3):
        base = prose(100 + family, 150, 5_000)
        rows += [(len(rows) + i, edited(base, 1_000 * family + i, generator.randrange(0, 14))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(docs, shingle=2)) == brute_components(rows, 2)


@pytest.mark.parametrize("nameless_copies", [1, 3])
def test_hub_with_a_null_id(spark, nameless_copies):
    """Edits of a text that are linked through it only, while all rows of that text have a null id."""
    base = prose(500, 150, 5_000)
    rows = [(None, base)] * nameless_copies + [(i, edited(base, 600 + i, 7)) for i in range(12)] + [(None, prose(501, 90, 5_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_components(rows, 2)
    assert sum(component == 0 for _, _, component in wanted) == 12 + nameless_copies
    assert found(near_duplicates(docs, shingle=2)) == wanted


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []
    assert drop_near_duplicates(no_docs).collect() == []


def test_one_of_each_group_stays(spark, odd_docs, odd_rows):
    kept = drop_near_duplicates(odd_docs, shingle=2)
    assert kept.columns == odd_docs.columns
    components = brute_components([row[:2] for row in odd_rows], 2)
    wanted = sorted({key for key, n, component in components if key is not None and n and key == component})
    with_words = [r for r in kept.collect() if r["doc_id"] is not None and (r["text"] or "").strip()]
    assert sorted(r["doc_id"] for r in with_words) == wanted
    wordless = sum(1 for row in odd_rows if row[0] is None or not (row[1] or "").strip())
    assert kept.count() == len(wanted) + wordless


def test_signature_estimates_similarity():
    one = shingle_set(prose(1, 400, 10_000).encode(), 2)
    other = shingle_set(edited(prose(1, 400, 10_000), 5, 20).encode(), 2)
    same = len(np.intersect1d(one, other))
    truth = same / (len(one) + len(other) - same)
    estimate = (signature(one, 448) == signature(other, 448)).mean()
    assert abs(estimate - truth) < 0.08
    tiny = signature(shingle_set(b"a b", 2), 448)
    assert (tiny == tiny[0]).all()
    assert len(set(band_keys(np.stack([tiny]), 64, 7)[0].tolist())) == 64


def test_links_within_equal_plain_comparison():
    generator = np.random.default_rng(1)
    hub = np.unique(generator.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([generator.permutation(hub)[: generator.integers(60, 100)], generator.integers(0, 1 << 62, 10, dtype=np.uint64)])) for _ in range(30)]
    rows = [
        {"a": bytes([i]), "root": bytes([i]), "left": True, "right": True, "size": len(s), "hub_size": len(hub),
         "lacks": len(np.setdiff1d(hub, s)), "differs": np.setxor1d(hub, s).tobytes()}
        for i, s in enumerate(sets)
    ]

    def linked(x, y):
        both = len(np.intersect1d(x, y))
        return 100 * both >= 70 * (len(x) + len(y) - both)

    wanted = {(bytes([i]), bytes([j])) for i in range(30) for j in range(30) if i != j and linked(sets[i], sets[j])}
    assert set(links_within(rows, 70)) == wanted


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(df.limit(0)).collect() == []
