"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Characters are read as classes, so the input product is a row of a table. Tags are
O and, per kind, a first and a following tag.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

HIDDEN = 16
#: Character classes: digit, a-z, A-Z, other letters, blanks, line ends, each ASCII mark.
DIGIT, LOWER, UPPER, OTHER, BLANK, LINE, MARKS = range(7)
CLASSES = MARKS + 128

Params = dict[str, np.ndarray]


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where(codes < 128, codes + MARKS, OTHER)
    out[(codes >= 48) & (codes <= 57)] = DIGIT
    out[(codes >= 97) & (codes <= 122)] = LOWER
    out[(codes >= 65) & (codes <= 90)] = UPPER
    out[(codes == 32) | (codes == 9) | (codes == 160)] = BLANK
    out[(codes == 10) | (codes == 13)] = LINE
    return out.astype(np.int16)


def fresh(tags: int, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    params: Params = {}
    for side in ("f", "b"):
        params["x" + side] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
        params["h" + side] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        params["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    params["out"] = rng.normal(0, 0.2, (2 * HIDDEN, tags))
    params["bias"] = np.zeros(tags)
    params["move"] = np.zeros((tags, tags))
    return params


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(chars: np.ndarray, params: Params, side: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction: (batch, time, HIDDEN)."""
    n, length = chars.shape
    h = np.zeros((n, HIDDEN), params["out"].dtype)
    c = np.zeros_like(h)
    states = np.empty((n, length, HIDDEN), h.dtype)
    trail = []
    order = range(length) if side == "f" else range(length - 1, -1, -1)
    table = params["x" + side] + params["c" + side]
    for t in order:
        gates = table[chars[:, t]] + h @ params["h" + side]
        ifo = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before_h, before_c = h, c
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[:, t] = h
        if keep:
            trail.append((t, before_h, before_c, i, f, o, g, squashed))
    return states, trail


def _lstm_back(chars: np.ndarray, params: Params, side: str, trail: list, d_states: np.ndarray) -> Params:
    grads = {k + side: np.zeros_like(params[k + side]) for k in "xhc"}
    d_h = np.zeros_like(d_states[:, 0])
    d_c = np.zeros_like(d_h)
    for t, before_h, before_c, i, f, o, g, squashed in reversed(trail):
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1 - squashed**2)
        d_gates = np.concatenate(
            [
                d_c * g * i * (1 - i),
                d_c * before_c * f * (1 - f),
                d_h * squashed * o * (1 - o),
                d_c * i * (1 - g**2),
            ],
            axis=1,
        )
        np.add.at(grads["x" + side], chars[:, t], d_gates)
        grads["h" + side] += before_h.T @ d_gates
        grads["c" + side] += d_gates.sum(axis=0)
        d_h = d_gates @ params["h" + side].T
        d_c = d_c * f
    return grads


def emissions(chars: np.ndarray, params: Params) -> np.ndarray:
    """Tag scores of windows of equal length: (batch, time, tags)."""
    both = [_lstm(chars, params, side, keep=False)[0] for side in "fb"]
    return np.concatenate(both, axis=2) @ params["out"] + params["bias"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _crf(scores: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients by the forward-backward sums."""
    n, length, k = scores.shape
    ahead = [scores[:, 0]]
    for t in range(1, length):
        ahead.append(scores[:, t] + _logsum(ahead[-1][:, :, None] + move, 1))
    back = [np.zeros((n, k))]
    for t in range(length - 1, 0, -1):
        back.append(_logsum(move + (scores[:, t] + back[-1])[:, None, :], 2))
    back.reverse()
    total = _logsum(ahead[-1], 1)
    d_scores = np.exp(np.stack(ahead, 1) + np.stack(back, 1) - total[:, None, None])
    d_move = np.zeros_like(move)
    for t in range(1, length):
        pair = ahead[t - 1][:, :, None] + move + (scores[:, t] + back[t])[:, None, :] - total[:, None, None]
        d_move += np.exp(pair).sum(axis=0)
    rows, times = np.arange(n)[:, None], np.arange(length)[None, :]
    gold = scores[rows, times, tags].sum(axis=1) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_scores[rows, times, tags] -= 1
    np.subtract.at(d_move, (tags[:, :-1], tags[:, 1:]), 1)
    return float((total - gold).mean()), d_scores / n, d_move / n


def train(chars: np.ndarray, tags: np.ndarray, kinds: int, steps: int, batch: int = 64, rate: float = 0.02) -> Params:
    """Fit to windows ``chars`` with ``tags``; the same input gives the same model."""
    params = fresh(1 + 2 * kinds)
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    rng = np.random.default_rng(4)
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(chars), min(batch, len(chars)))
        x, y = chars[chosen], tags[chosen]
        runs = {side: _lstm(x, params, side, keep=True) for side in "fb"}
        joint = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        _, d_scores, d_move = _crf(joint @ params["out"] + params["bias"], params["move"], y)
        d_joint = d_scores @ params["out"].T
        grads = {
            "out": np.einsum("nth,ntk->hk", joint, d_scores),
            "bias": d_scores.sum(axis=(0, 1)),
            "move": d_move,
            **_lstm_back(x, params, "f", runs["f"][1], d_joint[:, :, :HIDDEN]),
            **_lstm_back(x, params, "b", runs["b"][1], d_joint[:, :, HIDDEN:]),
        }
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, grad in grads.items():
            grad = np.clip(grad, -1, 1)
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.99 * v[name] + 0.01 * grad**2
            params[name] = params[name] - pace * (m[name] / (1 - 0.9**step)) / (
                np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8
            )
    return {name: p.astype(np.float32) for name, p in params.items()}


def best_tags(scores: Sequence[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best tag path of each sequence (Viterbi), sequences side by side."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: -len(scores[i]))
    if not order:
        return out
    lengths = np.array([len(scores[i]) for i in order])
    best = np.stack([scores[i][0] for i in order])
    came: list[np.ndarray] = []
    ends = np.empty(len(order), np.int64)
    for t in range(1, lengths[0] + 1):
        # Those of length t end here; the longer ones go on.
        on = int((lengths > t).sum())
        ends[on : len(best)] = best[on:].argmax(axis=1)
        if not on:
            break
        paths = best[:on, :, None] + move
        came.append(paths.argmax(axis=1).astype(np.int8))
        best = paths.max(axis=1) + np.stack([scores[i][t] for i in order[:on]])
    for row, i in enumerate(order):
        path = np.empty(lengths[row], np.int64)
        path[-1] = ends[row]
        for t in range(lengths[row] - 1, 0, -1):
            path[t - 1] = came[t - 1][row, path[t]]
        out[i] = path
    return out
