"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, documents packed in lanes.

Ids: 0 .. W - 1 are the words of the vocabulary from the most frequent one on, W is the end of a document, W + 1 any other word. A document's
inputs are its end mark and then its words; its targets are its words and then the end mark. The output is a softmax over classes times one over
the words of the class; end mark and other words are classes of their own. Before training the biases give the words' shares, whatever the state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Hidden units; classes; lanes side by side; steps of a window when training, through which gradients go, and when scoring.
UNITS, CLASSES, LANES, STEPS, SCORE_STEPS = 16, 32, 512, 16, 32

#: Learning rate and starting squares of Adagrad.
RATE, SQUARES = 0.15, 1e-6

F32 = np.float32


class Vocabulary:
    """Classes of words by equal shares of the square roots of their counts."""

    def __init__(self, counts: np.ndarray, documents: int, others: int):
        self.counts, self.size = np.asarray(counts, np.int64), len(counts)
        self.end, self.other = self.size, self.size + 1
        root = np.cumsum(np.sqrt(self.counts))
        assert self.other < 1 << 16, "ids take two bytes"
        cls = np.minimum((root / max(root[-1] if self.size else 1, 1) * CLASSES).astype(np.int64), CLASSES - 1)
        cls = np.unique(cls, return_inverse=True)[1] if self.size else cls
        n = int(cls.max()) + 1 if self.size else 0
        self.cls = np.r_[cls, n, n + 1].astype(np.int32)
        self.edges = np.searchsorted(cls, np.arange(n + 1))
        self.mass = np.r_[np.bincount(cls, self.counts, n) if n else [], documents, others] + 0.1


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights of a fixed seed, and biases that give the shares of the counts."""
    rng, v = np.random.default_rng(7), vocabulary.size
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
    bias = np.zeros(v, F32)
    bias[:] = np.log((vocabulary.counts + 0.1) / vocabulary.mass[vocabulary.cls[:v]])
    return {
        "x": small(v + 2, 3 * UNITS), "u": small(UNITS, 3 * UNITS), "wc": small(UNITS, len(vocabulary.mass)) * F32(0.1),
        "bc": np.log(vocabulary.mass / vocabulary.mass.sum()).astype(F32), "wo": small(v, UNITS) * F32(0.1), "bo": bias,
    }


class Lanes:
    """Documents side by side in lanes, and the windows over them."""

    def __init__(self, docs: list[np.ndarray], vocabulary: Vocabulary, lanes: list[list[int]] | int):
        """lanes: the documents of each lane, or into how many even lanes to cut the run of all documents."""
        end = np.array([vocabulary.end], np.int32)
        flat = range(len(docs)) if isinstance(lanes, int) else [i for own in lanes for i in own]
        self.inputs = np.concatenate([end[:0], *(x for i in flat for x in (end, docs[i]))])
        self.targets = np.concatenate([end[:0], *(x for i in flat for x in (docs[i], end))])
        self.doc = np.repeat(np.array(flat, np.int32), [len(docs[i]) + 1 for i in flat])
        if isinstance(lanes, int):
            self.length = np.diff(np.linspace(0, len(self.inputs), lanes + 1).astype(np.int64))
            self.begin = np.cumsum(self.length) - self.length
            order = np.argsort(-self.length, kind="stable")
            self.length, self.begin = self.length[order], self.begin[order]
        else:
            self.length = np.array([sum(len(docs[i]) + 1 for i in own) for own in lanes], np.int64)
            self.begin = np.cumsum(self.length) - self.length

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of steps x lanes, which of them are within their lane) for the lanes that go on; lanes are longest first."""
        for t in range(0, int(self.length.max(initial=0)), steps):
            k = int(np.searchsorted(-self.length, -t))  # lanes longer than t
            at = t + np.arange(steps)[:, None]
            inside = at < self.length[:k]
            yield np.where(inside, self.begin[:k] + at, 0), inside


def whole_lanes(docs: list[np.ndarray]) -> list[list[int]]:
    """Whole documents dealt to lanes, longest first to the shortest lane, so that lanes end close together; longest lanes first."""
    heap = [(0, k) for k in range(min(LANES, len(docs)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heap[0]
        heapq.heapreplace(heap, (n + len(docs[i]) + 1, k))
        held[k].append(i)
    return sorted(held, key=lambda own: -sum(len(docs[i]) + 1 for i in own))


def forward(p: dict, inputs: np.ndarray, h: np.ndarray, end: int) -> dict[str, np.ndarray]:
    """States of a window; a document's first input forgets what came before."""
    steps, k = inputs.shape
    n = UNITS
    pre = p["x"][inputs]
    before, h_all = np.empty((steps, k, n), F32), np.empty((steps, k, n), F32)
    gates, cand, an = np.empty((steps, k, 2 * n), F32), np.empty((steps, k, n), F32), np.empty((steps, k, n), F32)
    keep = (inputs != end).astype(F32)[:, :, None]
    pre[:, :, : 2 * n] *= F32(0.5)
    half = p["u"].copy()
    half[:, : 2 * n] *= F32(0.5)
    for t in range(steps):
        hp = np.multiply(h, keep[t], out=before[t])
        a = hp @ half
        g = gates[t]
        np.add(pre[t, :, : 2 * n], a[:, : 2 * n], out=g)
        np.tanh(g, out=g)
        g *= F32(0.5)
        g += F32(0.5)
        an[t] = a[:, 2 * n :]
        c = np.multiply(g[:, n:], an[t], out=cand[t])
        c += pre[t, :, 2 * n :]
        np.tanh(c, out=c)
        h = np.subtract(hp, c, out=h_all[t])
        h *= g[:, :n]
        h += c
    return {"before": before, "h": h_all, "gates": gates, "cand": cand, "an": an}


def _softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of the chosen columns, exponentials, places of the chosen ones and sums."""
    e = h @ w
    e += bias
    np.minimum(e, F32(60), out=e)
    place = np.arange(0, e.size, e.shape[1]) + which
    chosen = e.reshape(-1)[place]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], F32)
    logp = chosen - np.log(total)
    return logp, e, place, total


def _slopes(e: np.ndarray, place: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gradients at the outputs, in place."""
    e *= (F32(1) / total)[:, None]
    e.reshape(-1)[place] -= F32(1)
    return e


def outputs(p: dict, v: Vocabulary, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target (others: of their class), and with grads also the gradient at the states, per target."""
    cls = v.cls[target]
    order = np.argsort(cls.astype(np.uint8 if len(v.mass) < 256 else np.int32), kind="stable")  # classes lie together
    h, target, cls = h[order], target[order], cls[order]
    found = np.bincount(cls, minlength=len(v.mass))
    begin = np.cumsum(found) - found
    logp, e, place, total = _softmax(h, p["wc"], p["bc"], cls)
    dh = None
    if grads is not None:
        e = _slopes(e, place, total)
        grads["wc"] += h.T @ e
        grads["bc"] += np.ones(len(e), F32) @ e
        dh = e @ p["wc"].T
    for k in np.flatnonzero(found[: len(v.edges) - 1]):
        lo, hi = v.edges[k], v.edges[k + 1]
        if hi - lo == 1:
            continue
        at = slice(begin[k], begin[k] + found[k])
        own, w = h[at], p["wo"][lo:hi]
        part, e, place, total = _softmax(own, w.T, p["bo"][lo:hi], target[at] - lo)
        logp[at] += part
        if grads is not None:
            e = _slopes(e, place, total)
            grads["wo"][lo:hi] += e.T @ own
            grads["bo"][lo:hi] += np.ones(len(e), F32) @ e
            dh[at] += e @ w
    as_given = np.empty_like(logp)
    as_given[order] = logp
    if dh is None:
        return as_given, None
    slopes = np.empty_like(dh)
    slopes[order] = dh
    return as_given, slopes


def backward(p: dict, f: dict, inputs: np.ndarray, dh_all: np.ndarray, end: int, grads: dict) -> None:
    """Gradients of the recurrence, back to the start of the window."""
    steps, k, n = dh_all.shape
    dx, du = np.empty((steps, k, 3 * n), F32), np.empty((steps, k, 3 * n), F32)
    keep = (inputs != end).astype(F32)[:, :, None]
    back, ut = np.zeros((k, n), F32), p["u"].T.copy()
    slope = f["gates"] * (F32(1) - f["gates"])
    bend = F32(1) - f["cand"] * f["cand"]
    for t in range(steps - 1, -1, -1):
        d = dh_all[t] + back
        z, r = f["gates"][t, :, :n], f["gates"][t, :, n:]
        dc = d * (F32(1) - z)
        dc *= bend[t]
        x, u = dx[t], du[t]
        np.multiply(d, f["before"][t] - f["cand"][t], out=x[:, :n])
        np.multiply(dc, f["an"][t], out=x[:, n : 2 * n])
        x[:, : 2 * n] *= slope[t]
        x[:, 2 * n :] = dc
        u[:, : 2 * n] = x[:, : 2 * n]
        np.multiply(dc, r, out=u[:, 2 * n :])
        back = u @ ut
        back += d * z
        back *= keep[t]
    flat = dx.reshape(-1, 3 * n)
    grads["u"] += f["before"].reshape(-1, n).T @ du.reshape(-1, 3 * n)
    ids = inputs.reshape(-1)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    grads["x"][ids[first]] += np.add.reduceat(flat[order], first)


def train(p: dict[str, np.ndarray], v: Vocabulary, docs: list[np.ndarray], squares: dict[str, np.ndarray]) -> None:
    """One pass over the documents that changes p and squares in place: an Adagrad step a window.

    The run of all documents is cut into even lanes, so windows are full; states are carried from window to window and start anew with a
    document, and where a cut starts a lane within one.
    """
    held = Lanes(docs, v, LANES)
    h = np.zeros((LANES, UNITS), F32)
    scale = F32(1 / (STEPS * LANES))
    for at, inside in held.windows(STEPS):
        inputs, target = held.inputs[at], held.targets[at]
        f = forward(p, inputs, h[: at.shape[1]], v.end)
        h = f["h"][-1]
        grads = {name: np.zeros_like(x) for name, x in p.items()}
        full = bool(inside.all())
        states = f["h"].reshape(-1, UNITS) if full else f["h"][inside]
        _, dh = outputs(p, v, states, target.reshape(-1) if full else target[inside], grads)
        dh_all = dh.reshape(f["h"].shape) if full else np.zeros(f["h"].shape, F32)
        if not full:
            dh_all[inside] = dh
        backward(p, f, inputs, dh_all, v.end, grads)
        for name, g in grads.items():
            g *= scale
            squares[name] += g * g
            g *= F32(RATE)
            g /= np.sqrt(squares[name])
            p[name] -= g


def score(p: dict[str, np.ndarray], v: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document, the end mark included, by states carried from window to window; other words count with their class alone."""
    held = Lanes(docs, v, whole_lanes(docs))
    out = np.zeros(len(docs))
    h = np.zeros((len(held.length), UNITS), F32)
    for at, inside in held.windows(SCORE_STEPS):
        f = forward(p, held.inputs[at], h[: at.shape[1]], v.end)
        h = f["h"][-1]
        logp, _ = outputs(p, v, f["h"][inside], held.targets[at][inside])
        out += np.bincount(held.doc[at][inside], logp, len(docs))
    return out


def fresh_squares(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: np.full_like(x, SQUARES) for name, x in p.items()}
