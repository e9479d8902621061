import hashlib
import math

import pytest

from millrace.llm import mixing
from millrace.llm.mixing import mixed_documents, mixture, source_targets


def words(text):
    return len("".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ")) - "".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ").count("")


def brute(rows, weights=(5, 2, 1), share=1.5):
    names = sorted({row[3] for row in rows}, key=lambda name: (name is None, name))
    size = {name: sum(words(row[1]) for row in rows if row[3] == name) for name in names}
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    budget, target, open_ = share * sum(size.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[name] for name in open_)
        full = {name for name in open_ if 2 * size[name] <= level * weight[name]}
        if not full:
            target |= {name: level * weight[name] for name in open_}
            break
        target |= {name: 2.0 * size[name] for name in full}
        open_ -= full
    result = []
    for name in names:
        queue = sorted((hashlib.md5(f"mix:{'' if row[0] is None else row[0]}".encode()).hexdigest(), -1 if row[0] is None else row[0], words(row[1])) for row in rows if row[3] == name)
        before, limit = 0, math.floor(target[name] + 1e-9)
        for _, key, n in queue:
            taken = sum(max(0, min(n, limit - before - turn * size[name])) for turn in (0, 1))
            result.append((None if key == -1 else key, n, size[name], round(target[name], 6), taken))
            before += n
    return sorted(result, key=repr)


@pytest.mark.parametrize("in_a_range", [10_000, 1])
def test_odd_rows(odd_docs, odd_rows, monkeypatch, in_a_range):
    monkeypatch.setattr(mixing, "ROWS_IN_A_RANGE", in_a_range)
    result = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixture(odd_docs).collect()]
    assert sorted(result, key=repr) == brute(odd_rows)


def test_targets_never_pass_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1_000), ("c", 500), (None, 0), ("d", 3)], "source string, source_size long")
    rows = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(sizes).collect()}
    assert all(target <= 2 * size + 1e-6 for size, target in rows.values())
    assert sum(target for _, target in rows.values()) == pytest.approx(1.5 * 1_513)


def test_documents_come_in_order_and_as_often_as_taken(odd_docs, odd_rows):
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    taken = brute(odd_rows)
    copies = sum(math.ceil(t / n) for _, n, _, _, t in taken if n)
    assert mixed.count() == copies


def test_empty_table(no_docs):
    assert mixture(no_docs).collect() == []
    assert mixed_documents(no_docs).collect() == []
