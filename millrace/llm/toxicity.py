"""Toxicity of documents: a bidirectional recurrent network over all overlapping windows of their words.

The network is trained on the driver, on a bounded sample of labelled documents, and goes to the tasks with the code.
A document's label speaks of some place in it, so training first takes all windows of a document for what the
document is, then again and again only the window that the network itself scores highest. A document's score is that
of its highest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import ref, require
from .common import arrow_map
from .decontaminate import plain_words
from .gru import Adam, Weights, _sigmoid, forward, gradients, initial_weights, inputs, layers_for, layers_of, word_features

WINDOW, STRIDE = 32, 24
SAMPLE = 1_000  # documents of each label that the network is trained on, at most
SAMPLE_BYTES = 20_000  # of a document of the sample, at most; longer ones are only scored
ROUNDS, BATCH, RATE = 6, 128, 0.01
STEPS = 48  # of a round, at least, however small the sample is
FIRST_WINDOWS = 5_000  # of each label that the first round takes, at most
WINDOWS_AT_ONCE = 2_048
WORDS_REMEMBERED = 100_000  # projected by a task; a full memory is emptied, results do not change
THRESHOLD = 0.7


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; punctuation separates."""
    return plain_words(text.lower().encode()) if text else []


def window_starts(n_words: int) -> list[int]:
    """Windows overlap and cover every word; a text without words has none."""
    return [] if n_words == 0 else list(range(0, max(n_words - (WINDOW - STRIDE), 1), STRIDE))


def stacked(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts given as word numbers: (places, present), both (steps, windows), and each window's text."""
    starts = [window_starts(len(numbers)) for numbers in texts]
    padded = [np.concatenate([numbers, np.full(WINDOW, -1, np.int64)]) for numbers in texts]
    rows = [padded[owner][start : start + WINDOW] for owner, own in enumerate(starts) for start in own]
    table = np.array(rows, np.int64).reshape(-1, WINDOW).T
    owners = np.repeat(np.arange(len(texts)), [len(own) for own in starts])
    return np.maximum(table, 0), (table >= 0).astype(np.float32), owners


class Scorer:
    """Scores whole texts with given weights."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.known: dict[bytes, int] = {}
        self.layers = layers_of(weights, WORDS_REMEMBERED)

    def _numbers(self, words: list[list[bytes]]) -> list[np.ndarray]:
        flat = [word for text in words for word in text]
        found = list(map(self.known.get, flat))
        missing = [place for place, number in enumerate(found) if number is None]
        new = list({flat[place] for place in missing})
        if len(self.known) + len(new) > WORDS_REMEMBERED:
            self.known.clear()
            new, missing = list(set(flat)), range(len(flat))
            self.layers = layers_of(self.weights, max(WORDS_REMEMBERED, len(new)))
        if new:
            x = inputs(self.weights, word_features(new))
            for layer in self.layers:
                layer.fill(len(self.known), x)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for place in missing:
                found[place] = self.known[flat[place]]
        numbers = np.array(found, np.int64)
        return np.split(numbers, np.cumsum([len(text) for text in words])[:-1])

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logits, owners, places, present) of all windows of all texts."""
        places, present, owners = stacked(self._numbers([words_of(text) for text in texts]))
        logits = np.empty(len(owners), np.float32)
        for start in range(0, len(owners), WINDOWS_AT_ONCE):
            part = slice(start, start + WINDOWS_AT_ONCE)
            logits[part] = forward(self.weights, self.layers, places[:, part], present[:, part])
        return logits, owners, places, present

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits, owners, _, _ = self.window_logits(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owners, logits)
        return np.where(np.isneginf(best), 0.0, _sigmoid(best.astype(np.float64)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Weights:
    """Weights fitted to labelled texts. Without texts of both labels the network learns nothing and scores near 0."""
    weights = initial_weights(seed)
    if len(set(labels)) < 2:
        weights["d"] -= 10
        return weights
    random = np.random.Generator(np.random.PCG64(seed))
    words = [words_of(text) for text in texts]
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(word, len(vocabulary)) for word in text], np.int64) for text in words]
    names = list(vocabulary)
    places, present, owners = stacked(numbers)
    truth = np.array(labels, np.float32)
    optimiser = Adam(weights, RATE)
    for turn in range(ROUNDS):
        if turn == 0:  # as many windows of either label, each worth the same within its document
            toxic, clean = (random.permutation(np.flatnonzero(truth[owners] == label)) for label in (1, 0))
            size = min(len(toxic), len(clean), FIRST_WINDOWS)
            chosen = np.concatenate([toxic[:size], clean[:size]])
        else:
            layers = layers_for(weights, inputs(weights, word_features(names)))
            logits = np.concatenate([forward(weights, layers, places[:, at : at + 4096], present[:, at : at + 4096]) for at in range(0, len(owners), 4096)])
            order = np.lexsort((logits, owners))
            top = order[np.flatnonzero(np.diff(owners[order], append=-1))]
            clean = np.flatnonzero(truth[owners] == 0)
            chosen = np.concatenate([top, random.choice(clean, min(len(clean), len(top) // 2), replace=False)])
        optimiser.rate = RATE / (1 + turn)
        for _ in range(-(-STEPS // max(1, -(-len(chosen) // BATCH)))):
            chosen = random.permutation(chosen)
            for start in range(0, len(chosen), BATCH):
                part = chosen[start : start + BATCH]
                used, local = np.unique(places[:, part], return_inverse=True)
                said = truth[owners[part]]
                _, found = gradients(weights, [names[i] for i in used], local.reshape(WINDOW, -1), present[:, part], said, np.ones(len(part), np.float32))
                optimiser.step(weights, found)
    return weights


def training_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> tuple[list[str], list[int]]:
    """At most ``SAMPLE`` texts of each label, from rows that are not held out, the first in the order of a hash."""
    usable = labels.select(ref(id_column).alias("id"), ref(label_column).cast("int").alias("label"))
    usable = usable.where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("id", F.lit("sample")))
    some = [usable.where(F.col("label") == label).orderBy("turn", "id").limit(SAMPLE) for label in (0, 1)]
    texts = docs.select(ref(id_column).alias("id"), ref(text_column).cast("string").alias("text"))
    texts = texts.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "id")  # at most 2 * SAMPLE rows of a few bytes
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").collect()
    return [row["text"] for row in rows], [row["label"] for row in rows]


def held_out(row_id):
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(row_id.cast("string")) % 3 == 1, F.lit(False))


def _score(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                scores = scorer.scores(batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``: ``score`` from 0 to 1, ``predicted`` 1 from 0.7 on.

    Only texts are inputs of a score. Whole texts are read. Null and empty texts, and texts of separators alone,
    score 0. Null ids are not held out; repeated rows come back repeated. Without labels of both kinds all scores
    are near 0. Labels may repeat an id (the highest counts), be null or name no row. Other columns are not read.
    """
    require(docs, id_column, text_column)
    require(labels, id_column, label_column)
    weights = train(*training_sample(docs, labels, id_column, text_column, label_column))
    slim = docs.select(ref(id_column).alias("id"), ref(text_column).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    found = arrow_map(slim, _score(weights), f"id {kind}, score double")
    return found.select(
        F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
