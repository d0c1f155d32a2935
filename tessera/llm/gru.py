"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored output softmax."""

from __future__ import annotations

import numpy as np

#: Width of the state; words in flight at once and steps of a training window; steps of a scoring window.
HIDDEN, LANES, STEPS, SCORED_STEPS = 16, 512, 16, 64
RATE, CLIP = 0.01, 1.0
NAMES = ("into", "inner", "to_class", "class_bias", "to_word", "word_bias")
#: Id 0 is the end of a document, which also stands before its first word.
END = 0


def class_borders(counts: np.ndarray, classes: int) -> np.ndarray:
    """Cut words, the most frequent first, into classes of about equal sums of root counts."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    return np.unique(np.concatenate([[0], cuts, [len(counts)]]))


def fresh(counts: np.ndarray, borders: np.ndarray, seed: int = 0, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """First weights: small ones, and biases that give each word its share of the counts."""
    draw = np.random.Generator(np.random.PCG64(seed))
    n, c = len(counts), len(borders) - 1
    smooth = counts + 1.0
    sums = np.add.reduceat(smooth, borders[:-1])
    normal = lambda scale, *shape: (scale * draw.standard_normal(shape)).astype(np.float32)
    return {
        "into": normal(0.3, n, 3 * hidden), "inner": normal(0.5 / np.sqrt(hidden), hidden, 3 * hidden), "to_class": normal(0.1, hidden, c), "class_bias": np.log(sums / sums.sum()).astype(np.float32),
        "to_word": normal(0.1, n, hidden), "word_bias": np.log(smooth / np.repeat(sums, np.diff(borders))).astype(np.float32),
    }


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in NAMES])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _exponentials(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x) (in x's place) and its sums by row, both up to a factor for each row, and by the same factor the log of exp(x) at the places.

    One factor for all rows is enough unless they lie far apart; then each row has its own.
    """
    most = x.max(initial=0)
    if most - x.min(initial=0) > 60:
        most = x.max(axis=1, keepdims=True)
    x -= most
    said = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), said


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its softmax (in x's place) and the log of what it gives the place at."""
    x, sums, said = _exponentials(x, at)
    x /= sums[:, None]
    return x, said - np.log(sums)


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of what each row's softmax gives the place at; x is used up."""
    _, sums, said = _exponentials(x, at)
    return said - np.log(sums)


def step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit: gates and the next state."""
    n = h.shape[1]
    a = h @ w["inner"]
    gates = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
    r, z = gates[:, :n], gates[:, n:]
    new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
    return r, z, new, a[:, 2 * n :], new + z * (h - new)


def log_likelihood(w: dict[str, np.ndarray], borders: np.ndarray, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state: of its class, then of the word in the class."""
    of = np.searchsorted(borders, targets, "right") - 1
    out = _log_of(h @ w["to_class"] + w["class_bias"], of)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(borders)))
    for c in range(len(borders) - 1):
        rows = order[cuts[c] : cuts[c + 1]]
        if len(rows):
            p, q = borders[c], borders[c + 1]
            out[rows] += _log_of(h[rows] @ w["to_word"][p:q].T + w["word_bias"][p:q], targets[rows] - p)
    return out


def window_gradient(w: dict[str, np.ndarray], borders: np.ndarray, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over a window (steps by lanes), truncated at its beginning; the state to carry on; the summed loss."""
    steps, lanes = inputs.shape
    n = h.shape[1]
    x, kept = w["into"][inputs], []
    for t in range(steps):
        h = h * (inputs[t] != END)[:, None]
        r, z, new, a, after = step(w, x[t], h)
        kept.append((h, r, z, new, a))
        h = after
    states = np.empty((steps, lanes, n), np.float32)
    for t in range(steps):
        hp, r, z, new, _ = kept[t]
        states[t] = new + z * (hp - new)
    flat, goal, weight = states.reshape(-1, n), targets.ravel(), live.ravel().astype(np.float32)
    total = max(1.0, float(weight.sum()))
    of = np.searchsorted(borders, goal, "right") - 1
    rows_all = np.arange(len(goal))
    g, said = _softmax(flat @ w["to_class"] + w["class_bias"], of)
    loss = -float((said * weight).sum())
    g[rows_all, of] -= 1
    g *= (weight / total)[:, None]
    out = {"to_class": flat.T @ g, "class_bias": g.sum(axis=0), "to_word": np.zeros_like(w["to_word"]), "word_bias": np.zeros_like(w["word_bias"])}
    d_states = g @ w["to_class"].T
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(borders)))
    for c in range(len(borders) - 1):
        rows = order[cuts[c] : cuts[c + 1]]
        if len(rows):
            p, q = borders[c], borders[c + 1]
            at, own = goal[rows] - p, flat[rows]
            g, said = _softmax(own @ w["to_word"][p:q].T + w["word_bias"][p:q], at)
            loss -= float((said * weight[rows]).sum())
            g[np.arange(len(rows)), at] -= 1
            g *= (weight[rows] / total)[:, None]
            out["to_word"][p:q] = g.T @ own
            out["word_bias"][p:q] = g.sum(axis=0)
            d_states[rows] += g @ w["to_word"][p:q]
    d_states = d_states.reshape(steps, lanes, n)
    d_x = np.empty((steps, lanes, 3 * n), np.float32)
    d_inner, d_h = np.zeros_like(w["inner"]), np.zeros((lanes, n), np.float32)
    for t in reversed(range(steps)):
        hp, r, z, new, a = kept[t]
        d = d_states[t] + d_h
        d_new = d * (1 - z) * (1 - new * new)
        d_x[t, :, 2 * n :] = d_new
        d_x[t, :, :n] = d_new * a * r * (1 - r)
        d_x[t, :, n : 2 * n] = d * (hp - new) * z * (1 - z)
        d_a = d_x[t].copy()
        d_a[:, 2 * n :] *= r
        d_inner += hp.T @ d_a
        d_h = (d * z + d_a @ w["inner"].T) * (inputs[t] != END)[:, None]
    out["inner"] = d_inner
    ids = inputs.ravel()
    order = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    out["into"] = np.zeros_like(w["into"])
    out["into"][ids[order][firsts]] = np.add.reduceat(d_x.reshape(-1, 3 * n)[order], firsts, axis=0)
    return out, h, loss


class Trainer:
    """Adam over truncated windows."""

    def __init__(self, weights: dict[str, np.ndarray], borders: np.ndarray, rate: float = RATE):
        self.w, self.borders, self.rate, self.updates = weights, borders, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}
        self.loss, self.words = 0.0, 0

    def learn(self, ids: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> None:
        """ids: documents one after the other, an end after each. They are cut into lanes, and all of them learned from once."""
        if not len(ids):
            return
        lanes = max(1, min(lanes, len(ids) // steps))
        length = -(-len(ids) // lanes)
        inputs, targets = np.full(lanes * length, END, np.int64), np.zeros(lanes * length, np.int64)
        targets[: len(ids)] = ids
        inputs[1 : len(ids)] = ids[:-1]
        live = np.arange(lanes * length) < len(ids)
        inputs, targets, live = (v.reshape(lanes, length).T for v in (inputs, targets, live))
        h = np.zeros((lanes, self.w["inner"].shape[0]), np.float32)
        for t in range(0, length, steps):
            part = slice(t, t + steps)
            gradient, h, loss = window_gradient(self.w, self.borders, inputs[part], targets[part], live[part], h)
            self.loss, self.words = self.loss + loss, self.words + int(live[part].sum())
            self._update(gradient)

    def _update(self, gradient: dict[str, np.ndarray]) -> None:
        self.updates += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
        shrink = min(1.0, CLIP / (size + 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates) * min(1.0, self.updates / 20)
        for k, g in gradient.items():
            g = g * np.float32(shrink)
            self.mean[k] += np.float32(0.1) * (g - self.mean[k])
            self.square[k] += np.float32(0.001) * (g * g - self.square[k])
            self.w[k] -= np.float32(rate) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-7))


def document_scores(w: dict[str, np.ndarray], borders: np.ndarray, ids: np.ndarray, starts: np.ndarray, steps: int = SCORED_STEPS) -> np.ndarray:
    """Natural log likelihood of each word of documents (ids, an end closing each; starts has their beginnings and the end). The state runs through a document's windows to its end."""
    out, sizes = np.zeros(len(ids), np.float64), np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], starts[:-1][order]
    h, last = np.zeros((len(order), w["inner"].shape[0]), np.float32), np.full(len(order), END, np.int64)
    states, places, waiting = [], [], 0

    def flush() -> None:
        at = np.concatenate(places)
        out[at] = log_likelihood(w, borders, np.concatenate(states), ids[at])

    for t in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -t, "left"))  # those longer than t
        at = begins[:k] + t
        h, last = step(w, w["into"][last[:k]], h[:k])[-1], ids[at]
        states.append(h)
        places.append(at)
        waiting += k
        if waiting >= steps * 512:
            flush()
            states, places, waiting = [], [], 0
    if waiting:
        flush()
    return out
