"""A gated recurrent language model in numpy: class-factored output softmax, truncated
backpropagation, and state carried from window to window through whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

#: Steps of a window: gradients run back through so many. Where few long documents are left,
#: windows are longer, up to LONGEST in training, so that each has about WINDOW_TOKENS tokens.
WINDOW, LONGEST, WINDOW_TOKENS = 32, 256, 8192
#: Documents that step through time together, in scoring and in training.
LANES, TRAIN_LANES = 1024, 512
#: Rows whose class scores are worked on at once; this bounds memory.
BLOCK = 4096
F32 = np.float32


@dataclass
class Gru:
    """Parameters. Word ids are sorted by class: class k holds ids edges[k] to edges[k+1]."""

    gates: np.ndarray  # (words, 3h): input part of update, reset and candidate
    inner: np.ndarray  # (3h, h): recurrent part of the same
    first: np.ndarray  # (h,): state before a document
    to_class: np.ndarray  # (classes, h)
    class_bias: np.ndarray
    to_word: np.ndarray  # (words, h)
    word_bias: np.ndarray
    edges: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, edges: np.ndarray, hidden: int) -> Gru:
        """Small random weights; the biases already give the words' frequencies."""
        rng = np.random.default_rng(5)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
        mass = np.add.reduceat(counts + 1.0, edges[:-1])
        share = np.repeat(mass, np.diff(edges))
        return cls(
            small(len(counts), 3 * hidden), np.ascontiguousarray(small(hidden, 3 * hidden).T), np.zeros(hidden, F32),
            np.zeros((len(mass), hidden), F32), np.log(mass / mass.sum()).astype(F32),
            np.zeros((len(counts), hidden), F32), np.log((counts + 1.0) / share).astype(F32), edges,
        )

    def trained(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "edges"]

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.trained()]).astype(np.float64)

    def with_vector(self, v: np.ndarray) -> Gru:
        own, at = {"edges": self.edges}, 0
        for n in self.trained():
            a = getattr(self, n)
            own[n] = v[at : at + a.size].reshape(a.shape).astype(F32)
            at += a.size
        return Gru(**own)


#: Factors of the update, reset and candidate part by which _sigmoid gives the gates, and the candidate as 2 s - 1.
SIGNS = (-1, -1, -2)


def _signs(n: int) -> np.ndarray:
    return np.repeat(np.array(SIGNS, F32), n)


def _sigmoid(x: np.ndarray, out: np.ndarray) -> None:
    """Of -x, which is lost. By exp, as tanh takes twice the time; where it overflows, 0 is right."""
    np.exp(x, x)
    np.add(x, F32(1), x)
    np.reciprocal(x, out)


def _step(inner: np.ndarray, h: np.ndarray, x: np.ndarray, zr: np.ndarray, c: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next states, and the candidate's recurrent part. A column is a document's, so that
    all of a gate lies together. inner and x, the input's part of all three, are times _signs.
    Both gates go to zr, the candidate to c, the old states less it to less."""
    n = len(h)
    y = np.dot(inner, h)
    g, u = y[: 2 * n], y[2 * n :]
    g += x[:, : 2 * n].T
    _sigmoid(g.reshape(zr.shape), zr)
    np.multiply(zr[1], u, c)
    c += x[:, 2 * n :].T
    _sigmoid(c, c)
    np.add(c, c, c)
    np.subtract(c, F32(1), c)
    np.subtract(h, c, less)
    new = less * zr[0]
    new += c
    return new, u


def _window_words(words: np.ndarray, starts: np.ndarray, length: np.ndarray, t0: int, t1: int) -> tuple[np.ndarray, list[int]]:
    """The words of a window step by step, and how many documents reach each step."""
    live = np.searchsorted(-length, -np.arange(t0, t1), side="left").tolist()
    return np.concatenate([words[starts[:n] + t] for n, t in zip(live, range(t0, t1), strict=True)]), live


#: exp of numbers within this, products of two and sums of thousands of them stay finite and normal.
SAFE = 38.0


def _safe(*layers: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether no score can leave SAFE: states lie between -1 and 1, so a score is at most the
    sum of its absolute weights."""
    return all(float((np.abs(w) @ np.ones(w.shape[1], w.dtype) + np.abs(b)).max()) < SAFE for w, b in layers)


def _exp_scores(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e, f, totals): a row's probabilities are e * f / total. f is exp of the biases, which
    saves adding them to each row; or 1, where scores must first be less their largest."""
    x = states @ weights.T
    if safe:
        f = np.exp(bias)
    else:
        x += bias
        x -= x.max(axis=1, keepdims=True)
        f = np.ones_like(bias)
    np.exp(x, out=x)
    return x, f, x @ f


def _by_class(m: Gru, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(order that sorts words by class, class of each word so sorted, (class, from, to))."""
    # numpy sorts short integers by their digits
    own = np.repeat(np.arange(len(m.edges) - 1, dtype=np.uint16), np.diff(m.edges)).take(words)
    order = np.argsort(own, kind="stable")
    own = own.take(order)
    cuts = np.searchsorted(own, np.arange(len(m.edges), dtype=np.uint16)).tolist()
    return order, own, [(k, cuts[k], cuts[k + 1]) for k in range(len(m.edges) - 1) if cuts[k] < cuts[k + 1]]


def _parts(m: Gru, own: np.ndarray, words: np.ndarray, runs: list[tuple[int, int, int]]) -> Iterator[tuple[str, slice, slice, np.ndarray]]:
    """(layer, rows, outputs, target of each row among these): what a softmax each is over, of
    words that are sorted by class. The classes come in blocks, then each class with its words."""
    for a in range(0, len(own), BLOCK):
        yield "class", slice(a, a + BLOCK), slice(None), own[a : a + BLOCK]
    for k, a, b in runs:
        lo, hi = int(m.edges[k]), int(m.edges[k + 1])
        if hi - lo > 1:
            yield "word", slice(a, b), slice(lo, hi), words[a:b] - lo


def log_probs(m: Gru, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """ln p(word | state): that of its class times that within the class."""
    order, own, runs = _by_class(m, words)
    states, words = states.take(order, axis=0), words.take(order)
    layers = {"class": (m.to_class, m.class_bias), "word": (m.to_word, m.word_bias)}
    safe, rows = _safe(*layers.values()), np.arange(len(own))
    p = np.zeros(len(own))
    for layer, now, outputs, target in _parts(m, own, words, runs):
        weights, bias = (w[outputs] for w in layers[layer])
        e, f, total = _exp_scores(states[now], weights, bias, safe)
        p[now] += np.log(e.ravel().take(rows[: len(e)] * e.shape[1] + target) * f.take(target) / total)
    out = np.empty(len(order))
    out[order] = p
    return out


def _lanes(words: np.ndarray, offsets: np.ndarray, lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups of like length: (rows, starts, lengths), longest first."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), lanes):
        rows = order[at : at + lanes]
        yield rows, offsets[rows], length[rows]


def _windows(length: np.ndarray, longest: int, tokens: int = WINDOW_TOKENS) -> Iterator[tuple[int, int]]:
    """First step of each window and the one after its last; lengths fall."""
    t, end = 0, int(length[0]) if len(length) else 0
    while t < end:
        live = int(np.searchsorted(-length, -t, side="left"))
        to = min(t + min(max(WINDOW, tokens // live), longest), end)
        yield t, to
        t = to


def score(m: Gru, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ln p of each row's whole word sequence, the state running through all of it."""
    total, n = np.zeros(len(offsets) - 1), len(m.first)
    signs = _signs(n)
    inner, gates = m.inner * signs[:, None], m.gates * signs
    for rows, starts, length in _lanes(words, offsets, LANES):
        h = np.repeat(m.first[:, None], len(rows), axis=1)
        for t0, t1 in _windows(length, WINDOW_TOKENS):
            seen, live = _window_words(words, starts, length, t0, t1)
            x, states, at = gates.take(seen, axis=0), np.empty((len(seen), n), h.dtype), 0
            for own in live:
                if at == 0 or own < h.shape[1]:
                    h = h[:, :own]
                    zr, c, less = np.empty((2, n, own), h.dtype), np.empty((n, own), h.dtype), np.empty((n, own), h.dtype)
                now = slice(at, at + own)
                states[now] = h.T
                with np.errstate(over="ignore"):
                    h, _ = _step(inner, h, x[now], zr, c, less)
                at += own
            lane = np.concatenate([np.arange(n) for n in live])
            total[rows] += np.bincount(lane, weights=log_probs(m, states, seen), minlength=len(rows))
    return total


class Trainer:
    """Truncated backpropagation with Adagrad on a copy of a model; gradients stop at the
    border of a window, the state does not. A window has about ``tokens`` tokens and no
    more than ``longest`` steps."""

    def __init__(self, start: Gru, rate: float, tokens: int = WINDOW_TOKENS, longest: int = LONGEST):
        self.model = start.with_vector(start.vector())
        self.rate, self.tokens, self.longest = rate, tokens, longest
        self.squares = {n: np.full(getattr(start, n).shape, 1e-4, F32) for n in start.trained()}

    def learn(self, words: np.ndarray, offsets: np.ndarray, lanes: int = TRAIN_LANES) -> None:
        """One pass over the rows."""
        m = self.model
        for rows, starts, length in _lanes(words, offsets, lanes):
            h = np.repeat(m.first[None, :], len(rows), axis=0)
            for t0, t1 in _windows(length, self.longest, self.tokens):
                h = _window(m, self.squares, h, words, starts, length, t0, t1, self.rate)


def _window(m: Gru, squares: dict, h: np.ndarray, words: np.ndarray, starts: np.ndarray, length: np.ndarray, t0: int, t1: int, rate: float) -> np.ndarray:
    n, kind = h.shape[1], h.dtype
    seen, live = _window_words(words, starts, length, t0, t1)
    size, at, signs = len(seen), 0, _signs(n)
    inner, x = m.inner * signs[:, None], m.gates.take(seen, axis=0)
    x *= signs
    # what backpropagation needs, step after step: gates; old states less the candidates, and
    # these; reset gates and the candidates' recurrent part
    zr, lc, ru = (np.empty((2, n * size), kind) for _ in range(3))
    h, states = np.ascontiguousarray(h.T), np.empty((size, n), kind)
    with np.errstate(over="ignore"):
        for own in live:
            now, flat = slice(at, at + own), slice(n * at, n * (at + own))
            h = h[:, :own]
            states[now] = h.T
            less, c = lc[:, flat].reshape(2, n, own)
            h, u = _step(inner, h, x[now], zr[:, flat].reshape(2, n, own), c, less)
            ru[1, flat] = u.ravel()
            at += own
    order, own, runs = _by_class(m, seen)
    before, target = states.take(order, axis=0), seen.take(order)
    scale = F32(1 / size)

    grad = {name: np.zeros(getattr(m, name).shape, kind) for name in m.trained() if name not in ("gates", "inner")}
    layers = {"class": (m.to_class, m.class_bias), "word": (m.to_word, m.word_bias)}
    d_sorted, safe, rows = np.zeros_like(before), _safe(*layers.values()), np.arange(size)
    for layer, now, outputs, hit in _parts(m, own, target, runs):
        weights, bias = (w[outputs] for w in layers[layer])
        e, f, total = _exp_scores(before[now], weights, bias, safe)
        # what is the same for a row or for an output is multiplied in where there is less of it
        flat, at = e.ravel(), rows[: len(e)] * e.shape[1] + hit
        flat[at] -= total / f.take(hit)
        share = scale / total
        grad[f"to_{layer}"][outputs] += (e.T @ (before[now] * share[:, None])) * f[:, None]
        grad[f"{layer}_bias"][outputs] += (share @ e) * f
        d_sorted[now] += (e @ (weights * f[:, None])) * share[:, None]
    d_states = np.empty_like(d_sorted)
    d_states[order] = d_sorted

    # what does not depend on later steps is worked out for the whole window: slopes of update
    # gate and candidate by the new state, of the recurrent part and reset gate by the candidate
    z, r = zr
    keep = 1 - z
    lc[0] *= z
    lc[1] *= -lc[1]
    lc[1] += 1
    lc *= keep
    ru[0] = r
    ru[1] *= r * (1 - r) / kind.type(SIGNS[2])
    # of the recurrent part, update, reset and candidate, in rows that caches do not map to one place
    d = np.empty((4, n, size + 16), kind)[:, :, :size]
    at, back, rolled = size, np.zeros((n, 0), kind), np.ascontiguousarray(np.roll(m.inner, n, axis=0).T)
    for own in reversed(live):
        now, flat = slice(at - own, at), slice(n * (at - own), n * at)
        at -= own
        d_new = back
        if back.shape[1] < own:
            d_new = np.zeros((n, own), kind)
            d_new[:, : back.shape[1]] = back
        np.multiply(lc[:, flat].reshape(2, n, own), d_new, d[1::2, :, now])
        np.multiply(ru[:, flat].reshape(2, n, own), d[3, :, now], d[::2, :, now])
        back = np.dot(rolled, d[:3, :, now].reshape(3 * n, own))
        d_new *= z[flat].reshape(n, own)
        back += d_new
        back += d_states[now].T
    d = d.reshape(4 * n, size)
    grad["inner"] = np.roll(d[: 3 * n] @ states, -n, axis=0)
    if t0 == 0:
        grad["first"] = back.sum(axis=1)
    # gradients of equal words are added up
    held = np.flatnonzero(np.bincount(seen, minlength=len(m.gates)))
    place = np.zeros(len(m.gates), np.int64)
    place[held] = np.arange(len(held))
    nth = place.take(seen)
    grad["gates"] = np.stack([np.bincount(nth, weights=row, minlength=len(held)) for row in d[n:]], axis=1).astype(kind)

    norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
    shrink = F32(min(1.0, 1.0 / max(norm, 1e-12)))
    for name, g in grad.items():
        at = held if name == "gates" else slice(None)
        g *= shrink
        size = squares[name][at] + g * g
        squares[name][at] = size
        g *= F32(rate)
        g /= np.sqrt(size, size)
        getattr(m, name)[at] -= g
    return h.T
