"""A bidirectional LSTM over characters with CRF transitions between tags, in numpy.

Both directions run side by side. The input of a gate is a table row per character, so a step is one small product and
one tanh over all gates: sigmoids are halves of a tanh. Training is the exact gradient of the sequence likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _softmax_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """inputs: direction, character, gates. recurrent: direction, cell, gates. Gates: input, forget, output, update."""

    inputs: np.ndarray
    recurrent: np.ndarray
    emit: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @classmethod
    def start(cls, characters: int, cells: int, tags: int, seed: int = 3) -> "Tagger":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        model = cls(draw(2, characters, 4 * cells, scale=0.3), draw(2, cells, 4 * cells, scale=0.5 / np.sqrt(cells)),
                    draw(2 * cells, tags, scale=0.5 / np.sqrt(cells)), np.zeros(tags, np.float32),
                    np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32))
        model.inputs[:, :, cells : 2 * cells] += 0.5  # forget little at first
        return model

    @property
    def params(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.emit, self.bias, self.moves, self.first]

    def states(self, ids: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """Cell outputs (step, direction, row, cell) and, if ``keep``, what the gradient needs. ids: row, step."""
        rows, steps = ids.shape
        cells = self.recurrent.shape[1]
        both = np.stack([ids, ids[:, ::-1]])
        h = c = np.zeros((2, rows, cells), np.float32)
        out, kept = np.empty((steps, 2, rows, cells), np.float32), []
        side = np.arange(2)[:, None]
        for t in range(steps):
            a = np.tanh(self.inputs[side, both[:, :, t]] + h @ self.recurrent)
            s = 0.5 * a[..., : 3 * cells] + 0.5
            before, was = c, h
            c = s[..., cells : 2 * cells] * c + s[..., :cells] * a[..., 3 * cells :]
            tc = np.tanh(c)
            h = out[t] = s[..., 2 * cells :] * tc
            if keep:
                kept.append((a, s, before, tc, was))
        return out, kept

    def emissions(self, out: np.ndarray) -> np.ndarray:
        """Scores (row, step, tag) from the cell outputs."""
        whole = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)
        return (whole @ self.emit + self.bias).transpose(1, 0, 2)

    def score(self, ids: np.ndarray) -> np.ndarray:
        return self.emissions(self.states(ids, keep=False)[0])

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """The tags (row, step) of the best sequences."""
        rows, steps, tags = scores.shape
        total, back = scores[:, 0] + self.first, np.empty((steps, rows, tags), np.int8)
        for t in range(1, steps):
            step = total[:, :, None] + self.moves
            back[t] = step.argmax(axis=1)
            total = step.max(axis=1) + scores[:, t]
        path = np.empty((rows, steps), np.int8)
        path[:, -1] = total.argmax(axis=1)
        at = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][at, path[:, t]]
        return path

    def crf_gradient(self, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood, and its gradient for the scores, the moves and the first tag."""
        rows, steps, count = scores.shape
        forward, backward = np.empty((steps, rows, count)), np.zeros((steps, rows, count))
        forward[0] = scores[:, 0] + self.first
        for t in range(1, steps):
            forward[t] = _softmax_sum(forward[t - 1][:, :, None] + self.moves, 1) + scores[:, t]
        for t in range(steps - 2, -1, -1):
            backward[t] = _softmax_sum(self.moves + (scores[:, t + 1] + backward[t + 1])[:, None, :], 2)
        whole = _softmax_sum(forward[-1], 1)
        marginal = np.exp(forward + backward - whole[:, None])
        after = scores.transpose(1, 0, 2)[1:] + backward[1:] - whole[:, None]
        pairs = np.exp(forward[:-1][..., :, None] + self.moves + after[..., None, :]).sum(axis=(0, 1))
        at, along = np.arange(rows)[:, None], np.arange(steps)
        own = scores[at, along, tags].sum() + self.first[tags[:, 0]].sum() + self.moves[tags[:, :-1], tags[:, 1:]].sum()
        by_score = marginal.transpose(1, 0, 2)
        by_score[at, along, tags] -= 1
        np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
        return float(whole.sum() - own) / rows, by_score / rows, pairs / rows, by_score[:, 0].sum(axis=0) / rows

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        out, kept = self.states(ids)
        loss, by_score, by_moves, by_first = self.crf_gradient(self.emissions(out).astype(np.float64), tags)
        by_score = by_score.transpose(1, 0, 2).astype(np.float32)
        whole = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)
        grads = [np.zeros_like(p) for p in self.params]
        grads[2], grads[3] = np.einsum("trc,trk->ck", whole, by_score), by_score.sum(axis=(0, 1))
        grads[4], grads[5] = by_moves.astype(np.float32), by_first.astype(np.float32)
        cells = self.recurrent.shape[1]
        down = by_score @ self.emit.T
        down = np.stack([down[..., :cells], down[::-1, :, cells:]], axis=1)
        both = np.stack([ids, ids[:, ::-1]])
        by_h, by_c = np.zeros_like(out[0]), np.zeros_like(out[0])
        by_gates = np.empty((ids.shape[1], *out.shape[1:3], 4 * cells), np.float32)
        for t in range(ids.shape[1] - 1, -1, -1):
            a, s, before, tc, was = kept[t]
            dh = down[t] + by_h
            by_c = by_c + dh * s[..., 2 * cells :] * (1 - tc**2)
            g = by_gates[t]
            g[..., :cells] = by_c * a[..., 3 * cells :]
            g[..., cells : 2 * cells] = by_c * before
            g[..., 2 * cells : 3 * cells] = dh * tc
            g[..., : 3 * cells] *= 0.5
            g[..., 3 * cells :] = by_c * s[..., :cells]
            g *= 1 - a**2
            grads[1] += was.transpose(0, 2, 1) @ g
            by_h = g @ self.recurrent.transpose(0, 2, 1)
            by_c = by_c * s[..., cells : 2 * cells]
        for side in range(2):
            flat, order = by_gates[:, side].reshape(-1, 4 * cells), both[side].T.ravel()
            np.add.at(grads[0][side], order, flat)
        return loss, grads

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam with clipped gradients and a falling rate; the mean losses of the epochs."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        step, losses = 0, []
        steps = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for k in range(0, order.size, batch):
                chosen = order[k : k + batch]
                loss, grads = self.gradient(ids[chosen], tags[chosen])
                total += loss * chosen.size
                size = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads))
                step += 1
                scale = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self.params, grads, first, second):
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    p -= scale * m / (np.sqrt(v) + 1e-8)
            losses.append(total / len(ids))
        return losses
