"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding beside the mean embedding of its character trigrams, both by hash. Two gated
recurrent layers read a window forwards and backwards; attention weighs their states at each word; a logistic unit
scores the weighted mean. Gradients are by hand, steps by Adam.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORD_ROWS, LETTER_ROWS = 1 << 13, 1 << 13
WORD_SIZE, LETTER_SIZE, STATE, ATTENTION = 12, 12, 12, 8
INPUT = WORD_SIZE + LETTER_SIZE

Weights = dict[str, np.ndarray]


def initial_weights(seed: int) -> Weights:
    random = np.random.Generator(np.random.PCG64(seed))

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    weights = {"words": normal(WORD_ROWS, WORD_SIZE, scale=0.1), "letters": normal(LETTER_ROWS, LETTER_SIZE, scale=0.1)}
    for side in ("f", "b"):
        weights[f"W{side}"] = normal(INPUT, 3 * STATE, scale=INPUT**-0.5)
        weights[f"U{side}"] = normal(STATE, 3 * STATE, scale=STATE**-0.5)
        weights[f"c{side}"] = np.zeros(3 * STATE, np.float32)
    weights["A"] = normal(2 * STATE, ATTENTION, scale=0.3)
    weights["v"] = normal(ATTENTION, scale=0.3)
    weights["o"] = normal(2 * STATE, scale=0.3)
    weights["d"] = np.zeros(1, np.float32)
    return weights


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, letter rows of all words behind each other, number of letter rows of each word)."""
    rows = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.int64) & (WORD_ROWS - 1)
    signs = np.frombuffer(b"".join(b"\x01" + word + b"\x02" for word in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(word) for word in words], np.int64)  # as many trigrams as a word has bytes
    starts = np.cumsum(lengths + 2) - lengths - 2
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    codes = (signs[at] << np.uint64(16)) | (signs[at + 1] << np.uint64(8)) | signs[at + 2]
    return rows, ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64), lengths


def inputs(weights: Weights, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    rows, letters, lengths = features
    sums = np.add.reduceat(weights["letters"][letters], np.cumsum(lengths) - lengths, axis=0)
    return np.concatenate([weights["words"][rows], sums / lengths[:, None].astype(np.float32)], axis=1)


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


class Layer:
    """A gated recurrent layer's recurrent weights, by gate, and the projected inputs of the words it may meet."""

    def __init__(self, weights: Weights, side: str, capacity: int):
        self.W, self.c = weights[f"W{side}"], weights[f"c{side}"]
        self.U = [np.ascontiguousarray(weights[f"U{side}"][:, gate * STATE : (gate + 1) * STATE]) for gate in range(3)]
        self.tables = [np.empty((capacity, STATE), self.W.dtype) for _ in range(3)]

    def fill(self, start: int, x: np.ndarray) -> None:
        """Project the inputs of the words that have numbers from ``start`` on."""
        projected = x @ self.W + self.c
        for gate, table in enumerate(self.tables):
            table[start : start + len(x)] = projected[:, gate * STATE : (gate + 1) * STATE]

    def run(self, places: np.ndarray, present: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each step. ``places`` (steps, windows) tells which word stands where; where nothing is
        ``present`` the state is zero."""
        steps, windows = places.shape
        states = np.empty((steps, windows, STATE), self.W.dtype)
        state = np.zeros((windows, STATE), self.W.dtype)
        full = present.all(axis=1)
        for step in range(steps):
            at = places[step]
            update, reset, fresh = (table.take(at, axis=0, mode="clip") for table in self.tables)
            update += state @ self.U[0]
            reset += state @ self.U[1]
            turned = state @ self.U[2]
            for gate in (update, reset):  # the logistic function, by the hyperbolic tangent
                gate *= 0.5
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            fresh += reset * turned
            np.tanh(fresh, out=fresh)
            if keep is not None:
                keep.append((state, turned, update, reset, fresh))
            new = states[step]
            np.subtract(state, fresh, out=new)
            new *= update
            new += fresh
            if not full[step]:
                new *= present[step][:, None]
            state = new
        return states


def layers_of(weights: Weights, capacity: int) -> tuple[Layer, Layer]:
    return Layer(weights, "f", capacity), Layer(weights, "b", capacity)


def layers_for(weights: Weights, x: np.ndarray) -> tuple[Layer, Layer]:
    layers = layers_of(weights, len(x))
    for layer in layers:
        layer.fill(0, x)
    return layers


def forward(weights: Weights, layers: tuple[Layer, Layer], places: np.ndarray, present: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; ``places`` and ``present`` are (steps, windows), and each window has a word."""
    kept: dict[str, list | None] = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
    ahead = layers[0].run(places, present, kept["f"])
    back = layers[1].run(places[::-1], present[::-1], kept["b"])[::-1]
    states = np.concatenate([ahead, back], axis=2)
    looked = np.tanh(states @ weights["A"])
    pull = np.where(present > 0, looked @ weights["v"], -1e9)
    pull = np.exp(pull - pull.max(axis=0))
    share = pull / pull.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", share, states)
    if keep is not None:
        keep |= {"states": states, "looked": looked, "share": share, "pooled": pooled, **kept}
    return pooled @ weights["o"] + weights["d"]


def _layer_gradients(grad_states: np.ndarray, kept: list, present: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the projected inputs at each step, gradient of U)."""
    grad_inputs = np.empty((*present.shape, 3 * STATE), np.float32)
    grad_U = np.zeros_like(U)
    later = np.zeros_like(grad_states[0])
    for step in range(len(kept) - 1, -1, -1):
        state, turned, update, reset, fresh = kept[step]
        down = (grad_states[step] + later) * present[step][:, None]
        grad_fresh = down * (1 - update) * (1 - fresh**2)
        grad_update = down * (state - fresh) * update * (1 - update)
        grad_reset = grad_fresh * turned * reset * (1 - reset)
        grad_turned = np.concatenate([grad_update, grad_reset, grad_fresh * reset], axis=1)
        grad_inputs[step] = np.concatenate([grad_update, grad_reset, grad_fresh], axis=1)
        grad_U += state.T @ grad_turned
        later = down * update + grad_turned @ U.T
    return grad_inputs, grad_U


def gradients(weights: Weights, words: list[bytes], places: np.ndarray, present: np.ndarray, labels: np.ndarray, worth: np.ndarray) -> tuple[float, Weights]:
    """Mean logistic loss of weighted windows and its gradient in all weights."""
    features = word_features(words)
    x = inputs(weights, features)
    keep: dict = {}
    logits = forward(weights, layers_for(weights, x), places, present, keep)
    chance = _sigmoid(logits)
    loss = -(worth * (labels * np.log(chance + 1e-9) + (1 - labels) * np.log(1 - chance + 1e-9))).sum() / worth.sum()
    grad_logits = (worth * (chance - labels) / worth.sum()).astype(np.float32)
    found: Weights = {"o": keep["pooled"].T @ grad_logits, "d": grad_logits.sum(keepdims=True)}
    grad_pooled = grad_logits[:, None] * weights["o"]
    states, looked, share = keep["states"], keep["looked"], keep["share"]
    grad_share = np.einsum("nd,tnd->tn", grad_pooled, states)
    grad_pull = share * (grad_share - (share * grad_share).sum(axis=0))
    grad_looked = grad_pull[:, :, None] * weights["v"] * (1 - looked**2)
    found["v"] = np.einsum("tn,tna->a", grad_pull, looked)
    found["A"] = np.einsum("tnd,tna->da", states, grad_looked)
    grad_states = share[:, :, None] * grad_pooled + grad_looked @ weights["A"].T
    grad_x = np.zeros_like(x)
    for side, part, turn in (("f", slice(0, STATE), slice(None)), ("b", slice(STATE, 2 * STATE), slice(None, None, -1))):
        grad_inputs, found[f"U{side}"] = _layer_gradients(grad_states[turn, :, part], keep[side], present[turn], weights[f"U{side}"])
        grad_table = np.zeros((len(x), 3 * STATE), np.float32)
        np.add.at(grad_table, places[turn].ravel(), grad_inputs.reshape(-1, 3 * STATE))
        found[f"W{side}"] = x.T @ grad_table
        found[f"c{side}"] = grad_table.sum(axis=0)
        grad_x += grad_table @ weights[f"W{side}"].T
    rows, letters, lengths = features
    found["words"] = np.zeros_like(weights["words"])
    np.add.at(found["words"], rows, grad_x[:, :WORD_SIZE])
    found["letters"] = np.zeros_like(weights["letters"])
    np.add.at(found["letters"], letters, np.repeat(grad_x[:, WORD_SIZE:] / lengths[:, None].astype(np.float32), lengths, axis=0))
    return float(loss), found


class Adam:
    def __init__(self, weights: Weights, rate: float):
        self.rate, self.turn = rate, 0
        self.mean = {name: np.zeros_like(value) for name, value in weights.items()}
        self.square = {name: np.zeros_like(value) for name, value in weights.items()}

    def step(self, weights: Weights, found: Weights) -> None:
        self.turn += 1
        for name, gradient in found.items():
            self.mean[name] += 0.1 * (gradient - self.mean[name])
            self.square[name] += 0.001 * (gradient**2 - self.square[name])
            mean, square = self.mean[name] / (1 - 0.9**self.turn), self.square[name] / (1 - 0.999**self.turn)
            weights[name] -= self.rate * mean / (np.sqrt(square) + 1e-8)
