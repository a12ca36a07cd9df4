"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are ``WIDTH`` characters; shorter ones are padded. A character enters as its own unit and its class's, both
directions run as one batched product, and a linear layer gives each position's tag scores. The CRF adds
a score for every pair of neighbouring tags; pairs that no span can have are forbidden. Training is the
exact gradient of the sequence likelihood (forward and backward sums) through time, with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 64
HIDDEN = 24
_NEVER = -1e4
#: Characters: 128 of ASCII, then other letters, other digits, anything else, and padding.
_UNITS, PAD = 132, 131


def _classes() -> np.ndarray:
    """One row per unit: its own column, and its class's."""
    groups = [np.arange(48, 58), np.arange(65, 91), np.arange(97, 123), np.array([9, 10, 11, 12, 13, 32]), np.arange(128, 131)]
    own = np.zeros((_UNITS, _UNITS + len(groups)), np.float32)
    own[np.arange(_UNITS), np.arange(_UNITS)] = 1.0
    for g, members in enumerate(groups):
        own[members, _UNITS + g] = 1.0
    return own


_FEATURES = _classes()


def encode(window: str) -> list[int]:
    out = [c if (c := ord(ch)) < 128 else 128 if ch.isalpha() else 129 if ch.isdigit() else 130 for ch in window]
    return out + [PAD] * (WIDTH - len(out))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Tagger:
    """Tag 0 is outside; kind k begins with tag 1 + 2k and goes on with 2 + 2k."""

    kinds: int
    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    trans: np.ndarray

    @staticmethod
    def new(kinds: int, hidden: int = HIDDEN, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        tags = 1 + 2 * kinds

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        wx = draw(2, _FEATURES.shape[1] + 1, 4 * hidden, scale=0.2)
        wx[:, -1] = 0.0
        wx[:, -1, hidden:2 * hidden] = 1.0  # remember at first
        return Tagger(kinds, wx, draw(2, hidden, 4 * hidden, scale=hidden ** -0.5), draw(2, hidden, tags, scale=hidden ** -0.5),
                      np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32))

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bo, self.trans]

    def allowed(self) -> np.ndarray:
        """Transitions, with those that no span can have far below all others."""
        out = self.trans.copy()
        for k in range(self.kinds):
            others = [t for t in range(len(out)) if t not in (1 + 2 * k, 2 + 2 * k)]
            out[others, 2 + 2 * k] = _NEVER
        return out

    def _run(self, ids: np.ndarray, keep: bool = False):
        """Hidden states (2, width, windows, hidden), by position; what training needs, if ``keep``."""
        rows, width = ids.shape
        hidden = self.wh.shape[1]
        table = np.concatenate([_FEATURES, np.ones((_UNITS, 1), np.float32)], axis=1) @ self.wx
        h = np.zeros((2, rows, hidden), np.float32)
        c = np.zeros_like(h)
        states = np.empty((2, width, rows, hidden), np.float32)
        kept = []
        for t in range(width):
            z = np.matmul(h, self.wh)
            z[0] += table[0][ids[:, t]]
            z[1] += table[1][ids[:, width - 1 - t]]
            gates = _sigmoid(z[..., :3 * hidden])
            i, f, o = gates[..., :hidden], gates[..., hidden:2 * hidden], gates[..., 2 * hidden:]
            g = np.tanh(z[..., 3 * hidden:])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            if keep:
                kept.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            states[0, t], states[1, width - 1 - t] = h[0], h[1]
        return states, kept

    def _scores(self, states: np.ndarray) -> np.ndarray:
        """Tag scores (width, windows, tags)."""
        return states[0] @ self.wo[0] + states[1] @ self.wo[1] + self.bo

    @staticmethod
    def _sums(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the sums over all tag sequences before and after each position."""
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, len(scores)):
            ahead[t] = scores[t] + _sum_exp(ahead[t - 1][:, :, None] + trans, 1)
        for t in range(len(scores) - 2, -1, -1):
            behind[t] = _sum_exp(trans + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        rows, width = ids.shape
        hidden = self.wh.shape[1]
        states, kept = self._run(ids, keep=True)
        scores, trans = self._scores(states), self.allowed()
        ahead, behind = self._sums(scores, trans)
        whole = _sum_exp(ahead[-1], 1)
        at, own = np.arange(rows), tags.T
        path = sum(scores[t, at, own[t]] for t in range(width)) + sum(trans[own[t - 1], own[t]] for t in range(1, width))
        d_scores = np.exp(ahead + behind - whole[:, None])
        d_trans = np.zeros_like(self.trans)
        for t in range(1, width):
            pair = ahead[t - 1][:, :, None] + trans + (scores[t] + behind[t])[:, None, :] - whole[:, None, None]
            d_trans += np.exp(pair).sum(axis=0)
            np.add.at(d_trans, (own[t - 1], own[t]), -1.0)
        d_trans[trans <= _NEVER / 2] = 0.0
        for t in range(width):
            d_scores[t, at, own[t]] -= 1.0
        d_scores /= rows
        d_wo = np.stack([states[d].reshape(-1, hidden).T @ d_scores.reshape(width * rows, -1) for d in (0, 1)])
        d_states = np.stack([d_scores @ self.wo[0].T, d_scores @ self.wo[1].T])
        d_table = np.zeros((2, _UNITS, 4 * hidden), np.float32)
        d_wh = np.zeros_like(self.wh)
        dh, dc = np.zeros((2, rows, hidden), np.float32), np.zeros((2, rows, hidden), np.float32)
        for t in range(width - 1, -1, -1):
            h, before, i, f, o, g, squashed = kept[t]
            dh[0] += d_states[0, t]
            dh[1] += d_states[1, width - 1 - t]
            dc = dc + dh * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o),
                                 dc * i * (1 - g ** 2)], axis=-1)
            np.add.at(d_table[0], ids[:, t], dz[0])
            np.add.at(d_table[1], ids[:, width - 1 - t], dz[1])
            d_wh += np.matmul(h.transpose(0, 2, 1), dz)
            dh = np.matmul(dz, self.wh.transpose(0, 2, 1))
            dc = dc * f
        d_wx = np.concatenate([_FEATURES, np.ones((_UNITS, 1), np.float32)], axis=1).T @ d_table
        return float((whole - path).mean()), [d_wx, d_wh, d_wo, d_scores.sum(axis=(0, 1)), d_trans / rows]

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 1e-2,
              decay: float = 1e-4, seed: int = 3) -> list[float]:
        """Fit in place; the mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.parameters]
        square = [np.zeros_like(p) for p in self.parameters]
        # A small sample gets more epochs, so that there are at least some hundred steps.
        epochs = max(epochs, min(100, 300 * batch // max(len(ids), 1)))
        steps, step, losses = epochs * -(-len(ids) // batch), 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                loss, grads = self.gradients(ids[rows], tags[rows])
                total += loss * len(rows)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                slowed = rate * (1 - step / (steps + 1))
                for p, g, m, s in zip(self.parameters, grads, mean, square):
                    g = g * min(1.0, 5.0 / max(size, 1e-9)) + decay * p
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= slowed * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
            losses.append(total / max(len(order), 1))
        return losses

    def decode(self, ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Spans (start, end, kind, probability) of every window's best tag sequence. A span's probability
        is that of its exact start, end and kind under the model."""
        rows, width = ids.shape
        scores, trans = self._scores(self._run(ids)[0]), self.allowed()
        best, back = scores[0], np.zeros((width, *scores[0].shape), np.int8)
        for t in range(1, width):
            through = best[:, :, None] + trans
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t]
        tags = np.empty((width, rows), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(rows), tags[t]]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(rows)]
        marked = np.flatnonzero((tags > 0).any(axis=0))
        if not len(marked):
            return out
        scores = scores[:, marked]
        ahead, behind = self._sums(scores, trans)
        whole = _sum_exp(ahead[-1], 1)
        for j, row in enumerate(marked):
            own = tags[:, row]
            start = 0
            while start < width:
                end = start + 1
                if own[start]:
                    kind = (int(own[start]) - 1) // 2
                    while end < width and own[end] == 2 + 2 * kind:
                        end += 1
                    value = ahead[start, j, own[start]] + sum(
                        trans[own[t - 1], own[t]] + scores[t, j, own[t]] for t in range(start + 1, end))
                    if end < width:
                        # What follows must not go on with the span.
                        rest = trans[own[end - 1]] + scores[end, j] + behind[end, j]
                        value += _sum_exp(np.delete(rest, 2 + 2 * kind)[None], 1)[0]
                    out[row].append((start, end, kind, float(min(1.0, np.exp(value - whole[j])))))
                start = end
        return out
