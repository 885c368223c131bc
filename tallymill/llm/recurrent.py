"""A gated recurrent network over word classes, in numpy: truncated backpropagation and whole-text scoring.

Inputs are symbols: the frequent words, then the classes of all other words. The output is factored: a softmax over
classes, and within a class of frequent words one over its words; the words of the other classes share theirs by their
counts, which the caller adds.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np


@dataclass
class Weights:
    """``table``: what each input symbol adds to the gates; ``loop`` and ``bias``: the recurrent part;
    ``classes``, ``class_bias``: softmax over classes; ``words``, ``word_bias``: one softmax per frequent class."""

    table: np.ndarray
    loop: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def over(self, values: np.ndarray) -> Weights:
        """Weights of the same shapes whose arrays are views of the given ones."""
        out, at = [], 0
        for f in fields(self):
            old = getattr(self, f.name)
            out.append(values[at : at + old.size].reshape(old.shape))
            at += old.size
        return Weights(*out)

    def like(self, values: np.ndarray) -> Weights:
        return self.over(np.array(values, dtype=np.float32))


def start(class_counts: np.ndarray, word_counts: np.ndarray, hidden: int, seed: int = 1) -> Weights:
    """Random gates; the output's biases are the logarithms of the counts, so training starts from frequencies.

    ``class_counts``: of all classes; ``word_counts``: one row of words per frequent class (the first classes).
    """
    rng = np.random.default_rng(seed)
    heads, size = word_counts.shape
    symbols = heads * size + len(class_counts) - heads + 1  # the last one starts a text

    def normal(*shape):
        return rng.normal(0, 0.1, shape).astype(np.float32)

    def logs(counts):
        return np.log(np.maximum(counts, 0.5) / np.maximum(counts.sum(axis=-1, keepdims=True), 1)).astype(np.float32)

    return Weights(
        normal(symbols, 3 * hidden) * 5, normal(hidden, 3 * hidden), np.zeros(3 * hidden, dtype=np.float32),
        normal(hidden, len(class_counts)), logs(class_counts), normal(heads, hidden, size), logs(word_counts),
    )


def _parts(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The recurrent parts of the gates, with the sign changed, and of the candidate; the last column is the bias."""
    n = w.loop.shape[0]
    both = np.concatenate([w.loop, w.bias[None]]).T
    return np.negative(both[: 2 * n], order="C"), np.ascontiguousarray(both[2 * n :])


def _given(table: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """What the symbols (steps by texts) add: steps, then gates with the sign changed and candidate, then texts."""
    n = table.shape[1] // 3
    rows = table[symbols].transpose(0, 2, 1)
    out = np.empty(rows.shape, dtype=np.float32)
    np.negative(rows[:, : 2 * n], out=out[:, : 2 * n])
    out[:, 2 * n :] = rows[:, 2 * n :]
    return out


def _with_ones(state: np.ndarray) -> np.ndarray:
    """States of texts as columns, and a row of ones that meets the biases."""
    out = np.ones((state.shape[1] + 1, len(state)), dtype=np.float32)
    out[:-1] = state.T
    return out


def _gated(given: np.ndarray, state: np.ndarray, parts, gates, reset, c, new) -> None:
    """One gated step into the given arrays, texts as columns: keep gate ``z`` over reset gate ``r``, reset state,
    candidate ``c``, new state. ``state`` and ``reset`` end in a row of ones."""
    n = len(c)
    np.dot(parts[0], state, out=gates)
    gates += given[: 2 * n]
    np.exp(gates, out=gates)  # may be infinite, which is a gate of zero
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[n:], state[:n], out=reset[:n])
    np.dot(parts[1], reset, out=c)
    c += given[2 * n :]
    np.tanh(c, out=c)
    np.subtract(state[:n], c, out=new)  # z * state + (1 - z) * c
    new *= gates[:n]
    new += c


def _step(w: Weights, symbols: np.ndarray, state: np.ndarray):
    """One gated step of texts as rows: the new state, and keep gate ``z``, reset gate ``r``, reset state, candidate ``c``."""
    texts, n = state.shape
    gates, reset, c, new = (np.ones((k, texts), dtype=np.float32) for k in (2 * n, n + 1, n, n))
    with np.errstate(over="ignore"):
        _gated(_given(w.table, symbols[None])[0], _with_ones(state), _parts(w), gates, reset, c, new)
    return new.T, (gates[:n].T, gates[n:].T, reset[:n].T, c.T)


def _classes(w: Weights, targets: np.ndarray) -> np.ndarray:
    heads, _, size = w.words.shape
    return np.where(targets < heads * size, targets // size, targets - heads * size + heads)


class _Heads:
    """The output's weights with their biases as one more input (the ones at the end of states)."""

    def __init__(self, w: Weights):
        self.classes = np.concatenate([w.classes, w.class_bias[None]]).T
        self.words = np.concatenate([w.words, w.word_bias[:, None]], axis=1)
        self.most = max(float(np.abs(self.classes).sum(axis=1).max()), float(np.abs(self.words).sum(axis=1).max()))

    def small(self, states: np.ndarray) -> bool:
        """Whether no score can come near the largest power of e that a float holds, nor near zero."""
        return self.most * max(float(states.max(initial=1)), -float(states.min(initial=-1))) < 75

    def words_of(self, states: np.ndarray, classes: np.ndarray):
        """The places of targets of frequent classes, class by class, with the runs of each class that occurs, and their
        states and scores of all words of their class."""
        heads, _, size = self.words.shape
        order = np.argsort(classes.astype(np.int16) if len(self.classes) < 1 << 15 else classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(heads + 1)).tolist()
        order = order[: cuts[-1]]
        runs = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        own = states[order]
        inner = np.empty((len(order), size), dtype=np.float32)
        for k, a, b in runs:
            np.dot(own[a:b], self.words[k], out=inner[a:b])
        return order, runs, own, inner


def _powers(x: np.ndarray, axis: int, small: bool) -> np.ndarray:
    """Makes scores powers of e, each up to a factor of its row or column, whose sums it returns."""
    if not small:
        x -= x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    return x.sum(axis=0) if axis == 0 else x @ np.ones(x.shape[1], dtype=np.float32)


def _log_share(x: np.ndarray, axis: int, at: tuple, small: bool) -> np.ndarray:
    """The log-softmax of each row or column at one place; overwrites ``x``."""
    if not small:
        x -= x.max(axis=axis, keepdims=True)
    found = x[at]
    return found - np.log(_powers(x, axis, True))


def _log_probabilities(heads: _Heads, states: np.ndarray, targets: np.ndarray, classes: np.ndarray, rows: int) -> np.ndarray:
    """The same of states that end in ones."""
    out = np.empty(len(targets), dtype=np.float32)
    small, size = heads.small(states), heads.words.shape[2]
    for at in range(0, len(targets), rows):
        some, goals, of, found = (x[at : at + rows] for x in (states, targets, classes, out))
        found[:] = _log_share(heads.classes @ some.T, 0, (of, np.arange(len(of))), small)
        order, _, _, inner = heads.words_of(some, of)
        found[order] += _log_share(inner, 1, (np.arange(len(order)), goals[order] % size), small)
    return out


def log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Natural logarithms of each target symbol's class, times its word in a frequent class; ``rows`` at a time."""
    return _log_probabilities(_Heads(w), np.ascontiguousarray(_with_ones(states).T), targets, _classes(w, targets), rows)


def score(w: Weights, texts: list[np.ndarray], window: int = 64, rows: int = 512) -> np.ndarray:
    """The log-likelihood of each whole text of symbols; the state is carried from window to window.

    ``rows`` texts of about the same length go at a time, so that what a step works on stays near the processor.
    """
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    out = np.zeros(len(texts))
    n = w.loop.shape[0]
    table = w.table.copy()
    np.negative(table[:, : 2 * n], out=table[:, : 2 * n])
    parts, heads, class_of = _parts(w), _Heads(w), _classes(w, np.arange(len(w.table)))
    with np.errstate(over="ignore"):
        for at in range(0, len(order), rows):
            some = order[at : at + rows]
            out[some] = _scores([texts[k] for k in some], table, parts, heads, class_of, window)
    return out


def _scores(texts: list[np.ndarray], table, parts, heads: _Heads, class_of: np.ndarray, window: int) -> np.ndarray:
    """The log-likelihoods of texts, the longest first; ``table``: with the sign of the gates changed."""
    hidden = len(parts[1])
    sizes = np.array([len(t) for t in texts])
    total = np.zeros(len(texts))
    state = _with_ones(np.zeros((len(texts), hidden), dtype=np.float32))
    previous = np.full(len(texts), len(table) - 1)
    for at in range(0, int(sizes.max(initial=0)), window):
        live = int(np.searchsorted(-sizes, -at))  # longer than ``at``, in front
        width = min(window, int(sizes[0]) - at)
        block = np.zeros((live, width), dtype=np.int64)
        for k in range(live):
            part = texts[k][at : at + width]
            block[k, : len(part)] = part
        block = np.ascontiguousarray(block.T)
        counts = np.searchsorted(-sizes[:live], -(at + np.arange(width))).tolist()
        seen = np.ones((sum(counts), hidden + 1), dtype=np.float32)
        done, n = 0, -1
        for t, count in enumerate(counts):
            if count != n:  # texts have ended
                n = count
                state, after = np.ascontiguousarray(state[:, :n]), np.ones((hidden + 1, n), dtype=np.float32)
                gates, reset, c = (np.ones((k, n), dtype=np.float32) for k in (2 * hidden, hidden + 1, hidden))
            _gated(table.take(previous[:n], axis=0).T, state, parts, gates, reset, c, after[:-1])
            state, after = after, state
            seen[done : done + n, :-1] = state[:-1].T
            previous = block[t]
            done += n
        targets = block[np.arange(live) < np.array(counts)[:, None]]
        got = _log_probabilities(heads, seen, targets, class_of[targets], 1024)
        text = np.concatenate([np.arange(n) for n in counts])
        total[:live] += np.bincount(text, got, minlength=live)
    return total


def gradient(w: Weights, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray, g: Weights | None = None):
    """Gradient of the mean loss of one window (rows: texts, columns: steps), truncated at its start; the last state.

    A text that has ended (its ``live`` is over) adds nothing, and its last state means nothing.
    ``g``: zeros that take the gradient.
    """
    if g is None:
        g = w.over(np.zeros(sum(getattr(w, f.name).size for f in fields(w)), dtype=np.float32))
    heads, hidden, size = w.words.shape
    n, width = inputs.shape
    parts, output = _parts(w), _Heads(w)
    read = np.ascontiguousarray(inputs.T)
    given = _given(w.table, read)
    gates, candidates = (np.empty((width, k * hidden, n), dtype=np.float32) for k in (2, 1))
    resets, states = (np.ones((k, hidden + 1, n), dtype=np.float32) for k in (width, width + 1))
    states[0, :-1] = state.T
    with np.errstate(over="ignore"):
        for t in range(width):
            _gated(given[t], states[t], parts, gates[t], resets[t], candidates[t], states[t + 1, :-1])
    seen = states[1:].transpose(0, 2, 1).reshape(-1, hidden + 1)
    goals, alive = targets.T.ravel(), live.T.ravel()
    share = alive.astype(np.float32) / max(int(alive.sum()), 1)
    classes = _classes(w, goals)
    small = output.small(state)  # later states are between these and one

    wrong = output.classes @ seen.T
    wrong *= share / _powers(wrong, 0, small)
    wrong[classes, np.arange(len(goals))] -= share
    of_classes = wrong @ seen
    g.classes[:], g.class_bias[:] = of_classes[:, :-1].T, of_classes[:, -1]
    into = wrong.T @ output.classes[:, :-1]
    order, runs, own, inner = output.words_of(seen, classes)
    share = share[order]
    inner *= (share / _powers(inner, 1, small))[:, None]
    inner[np.arange(len(order)), goals[order] % size] -= share
    of_words = np.empty((len(order), hidden), dtype=np.float32)
    both = np.zeros_like(output.words)
    turned = w.words.transpose(0, 2, 1)
    for k, a, b in runs:
        some = inner[a:b]
        np.dot(own[a:b].T, some, out=both[k])
        np.dot(some, turned[k], out=of_words[a:b])
    g.words[:], g.word_bias[:] = both[:, :-1], both[:, -1]
    into[order] += of_words
    into = np.ascontiguousarray(into.reshape(width, n, hidden).transpose(0, 2, 1))

    befores, z, r = states[:-1, :-1], gates[:, :hidden], gates[:, hidden:]
    slope = gates * (1 - gates)
    by_keep = (befores - candidates) * slope[:, :hidden]
    by_reset = befores * slope[:, hidden:]
    by_candidate = (1 - candidates * candidates) * (1 - z)
    loops = np.ascontiguousarray(w.loop[:, : 2 * hidden]), np.ascontiguousarray(w.loop[:, 2 * hidden :])
    back = np.zeros((hidden, n), dtype=np.float32)
    for t in range(width - 1, -1, -1):
        d, own = into[t], given[t]  # what was given is read no more: its place takes the gradient
        d += back
        dc = np.multiply(d, by_candidate[t], out=own[2 * hidden :])
        dreset = np.dot(loops[1], dc)
        np.multiply(d, by_keep[t], out=own[:hidden])
        np.multiply(dreset, by_reset[t], out=own[hidden : 2 * hidden])
        back = np.dot(loops[0], own[: 2 * hidden])
        dreset *= r[t]
        back += dreset
        d *= z[t]
        back += d
    for low, high, seen in ((0, 2 * hidden, states[:-1]), (2 * hidden, 3 * hidden, resets)):
        both = np.matmul(given[:, low:high], seen.transpose(0, 2, 1)).sum(axis=0)
        g.loop[:, low:high], g.bias[low:high] = both[:, :-1].T, both[:, -1]
    places = read[:, None] * (3 * hidden) + np.arange(3 * hidden)[:, None]
    g.table.reshape(-1)[:] = np.bincount(places.ravel(), given.ravel(), minlength=g.table.size)
    return g, states[-1, :-1].T


class Trainer:
    """Adam steps over windows of several texts at once; a row that ends takes the next text, with a fresh state."""

    def __init__(self, w: Weights, rate: float = 0.01, rows: int = 64, window: int = 16):
        self.rate, self.rows, self.window = rate, rows, window
        self.flat = w.flat().astype(np.float32)
        self.w = w.over(self.flat)
        self.found, self.mean, self.square = (np.zeros_like(self.flat) for _ in range(3))
        self.gradient = w.over(self.found)
        self.steps = self.seen = 0
        self.waiting: list[np.ndarray] = []
        # each row's text, its length and what was read of it
        self.texts = np.zeros((rows, window + 1), dtype=np.int64)
        self.sizes, self.at = np.zeros((2, rows), dtype=np.int64)
        self.state = np.zeros((rows, w.loop.shape[0]), dtype=np.float32)

    def add(self, texts: list[np.ndarray]) -> None:
        opening = len(self.w.table) - 1
        self.waiting += [np.append(opening, t) for t in texts if len(t)]
        while len(self.waiting) > self.rows:
            self._window()

    def finish(self) -> None:
        while self.waiting or (self.sizes - self.at > 1).any():
            self._window()

    def _window(self) -> None:
        for k in np.flatnonzero(self.sizes - self.at < 2)[: len(self.waiting)].tolist():
            text = self.waiting.pop()
            if (more := len(text) + self.window - self.texts.shape[1]) > 0:
                self.texts = np.pad(self.texts, ((0, 0), (0, more)))
            self.texts[k, : len(text)] = text
            self.sizes[k], self.at[k], self.state[k] = len(text), 0, 0
        steps = np.minimum(self.at, self.sizes)[:, None] + np.arange(self.window + 1)
        read = np.take_along_axis(self.texts, np.minimum(steps, self.texts.shape[1] - 1), axis=1)
        live = steps[:, 1:] < self.sizes[:, None]
        self.at += self.window
        self.found[:] = 0
        inputs, targets = np.where(live, read[:, :-1], 0), np.where(live, read[:, 1:], 0)
        _, self.state = gradient(self.w, inputs, targets, live, self.state, self.gradient)
        flat = np.clip(self.found, -1, 1, out=self.found)
        self.steps += 1
        self.seen += int(live.sum())
        self.mean *= 0.9
        self.mean += flat
        flat *= flat
        self.square *= 0.99
        self.square += flat
        # the averages are these sums times 0.1 and 0.01, each over what its weights add up to
        rate = 0.1 * self.rate / (1 - 0.9**self.steps)
        step = np.sqrt(self.square, out=flat)
        step *= (0.01 / (1 - 0.99**self.steps)) ** 0.5 / rate
        step += 1e-6 / rate
        np.divide(self.mean, step, out=step)
        self.flat -= step
