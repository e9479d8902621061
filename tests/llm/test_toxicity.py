import zlib

import numpy as np
from conftest import prose

from millrace.llm import toxicity as module
from millrace.llm.gru import gradients, initial_weights
from millrace.llm.toxicity import Scorer, toxicity, train, window_starts, words_of


def test_gradients_equal_differences():
    weights = {name: value.astype(np.float64) for name, value in initial_weights(1).items()}
    generator = np.random.default_rng(0)
    words = [b"abc", b"de", b"f", b"ghij"]
    places, present = generator.integers(0, 4, (5, 3)), np.ones((5, 3))
    present[3:, 1] = present[4:, 2] = 0
    labels, worth = np.array([1.0, 0, 1]), np.ones(3)
    _, found = gradients(weights, words, places, present, labels, worth)
    for name, value in weights.items():
        for place in np.argwhere(found[name] != 0)[:: max(1, found[name].size // 7)][:5]:
            place, kept = tuple(place), value[tuple(place)]
            sides = []
            for step in (1e-4, -1e-4):
                value[place] = kept + step
                sides.append(gradients(weights, words, places, present, labels, worth)[0])
            value[place] = kept
            assert abs((sides[0] - sides[1]) / 2e-4 - found[name][place]) < 1e-5


def test_windows_overlap_and_cover_every_word():
    for n in range(200):
        covered = {place for start in window_starts(n) for place in range(start, min(start + module.WINDOW, n))}
        assert covered == set(range(n))
    assert all(b - a < module.WINDOW for a, b in zip(window_starts(500), window_starts(500)[1:]))


def test_scores_do_not_depend_on_batches(monkeypatch):
    texts = [prose(i, 5 + 30 * i) for i in range(12)] + [None, "", " \n"]
    weights = initial_weights(3)
    whole = Scorer(weights).scores(texts)
    monkeypatch.setattr(module, "WORDS_REMEMBERED", 40)
    scorer = Scorer(weights)
    single = np.concatenate([scorer.scores([text]) for text in texts])
    assert np.allclose(whole, single, atol=1e-5)
    assert whole[-3:].tolist() == [0, 0, 0]
    assert words_of("A-b, É") == [b"a", b"b", "é".encode()]


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(module, "SAMPLE", 250)
    insults = ["nastyface", "badbad", "uglything"]
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60 + i % 200).split(" ")
        toxic = i % 3 == 0
        if toxic:
            words[i % len(words)] = insults[i % 9 // 3] + ("s" if i % 2 else "")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, "no id"), (700, None), (701, ""), (3, rows[3][1])]
    labels += [(None, 1), (5, None), (900, 1)]
    result = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(result) == len(rows)
    held = [r for r in result if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in result if r["doc_id"] is not None)
    right = sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    assert len(held) > 100 and right >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in result)
    assert {r["score"] for r in result if r["doc_id"] in (700, 701)} == {0.0}


def test_without_labels_of_both_kinds(spark, odd_docs, odd_rows, no_docs):
    one = spark.createDataFrame([(7, 0), (8, 0)], "doc_id long, toxic int")
    result = toxicity(odd_docs, one).collect()
    assert len(result) == len(odd_rows) and max(r["score"] for r in result) < 0.01
    assert toxicity(no_docs, one.limit(0)).collect() == []
    assert train([], [])["d"][0] < 0
