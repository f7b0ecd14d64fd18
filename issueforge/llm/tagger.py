"""Character-level bidirectional LSTM with a CRF output layer, in numpy."""

from __future__ import annotations

import numpy as np

ALPHABET = 130  # 0 pads, 1 to 128 are the ASCII characters, 129 is any other
HIDDEN = 16


def encode(text: str, start: int, size: int) -> np.ndarray:
    """Character ids of text[start : start + size]; places outside the text are padding."""
    out = np.zeros(size, dtype=np.int64)
    a, b = max(start, 0), min(start + size, len(text))
    if b > a:
        points = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[a - start : b - start] = np.where(points < 128, points + 1, ALPHABET - 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Parameters and the three passes: training step, marginals, best path.  Windows are (n, size) ids."""

    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        near = lambda *shape: rng.normal(size=shape) * 0.2
        self.p = {"trans": np.zeros((tags, tags)), "start": np.zeros(tags), "bias": np.zeros(tags)}
        for side in "fb":
            self.p |= {f"{side}W": near(ALPHABET, 4 * hidden), f"{side}U": near(hidden, 4 * hidden), f"{side}V": near(hidden, tags)}
            self.p[f"{side}c"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    # recurrent layers

    def _run(self, ids: np.ndarray, side: str, keep: bool):
        """Hidden states (size, n, hidden) in reading order of the side, and what the way back needs."""
        n, size, h = len(ids), ids.shape[1], self.hidden
        w, u, c0 = self.p[f"{side}W"], self.p[f"{side}U"], self.p[f"{side}c"]
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        states, saved = np.zeros((size, n, h)), []
        for t in range(size):
            z = w[ids[:, t]] + state @ u + c0
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, previous = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            states[t] = state
            if keep:
                saved.append((gates, new, before, previous, squashed))
        return states, saved

    def _back(self, ids: np.ndarray, side: str, saved: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        h, u = self.hidden, self.p[f"{side}U"]
        g_w, g_u, g_c = np.zeros_like(self.p[f"{side}W"]), np.zeros_like(u), np.zeros(4 * h)
        d_state, d_cell = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
        for t in range(len(saved) - 1, -1, -1):
            gates, new, before, previous, squashed = saved[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            d_state = d_state + d_states[t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dz = np.hstack(
                [d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - new**2)]
            )
            np.add.at(g_w, ids[:, t], dz)
            g_u += previous.T @ dz
            g_c += dz.sum(axis=0)
            d_state, d_cell = dz @ u.T, d_cell * f
        return {f"{side}W": g_w, f"{side}U": g_u, f"{side}c": g_c}

    def _emissions(self, ids: np.ndarray, keep: bool = False):
        forward, saved_f = self._run(ids, "f", keep)
        backward, saved_b = self._run(ids[:, ::-1], "b", keep)
        scores = forward @ self.p["fV"] + backward[::-1] @ self.p["bV"] + self.p["bias"]
        return scores, (forward, saved_f, backward, saved_b)

    # conditional random field

    def _chains(self, scores: np.ndarray):
        trans = self.p["trans"]
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.p["start"]
        for t in range(1, len(scores)):
            alpha[t] = scores[t] + _logsumexp(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(len(scores) - 2, -1, -1):
            beta[t] = _logsumexp(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _logsumexp(alpha[-1], 1)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradient."""
        n, size = ids.shape
        scores, (forward, saved_f, backward, saved_b) = self._emissions(ids, keep=True)
        alpha, beta, total = self._chains(scores)
        rows = np.arange(n)
        gold = self.p["start"][tags[:, 0]] + sum(scores[t, rows, tags[:, t]] for t in range(size))
        gold = gold + sum(self.p["trans"][tags[:, t - 1], tags[:, t]] for t in range(1, size))
        d_scores = np.exp(alpha + beta - total[None, :, None])
        g_start = d_scores[0].sum(axis=0) - np.bincount(tags[:, 0], minlength=self.tags)
        for t in range(size):
            d_scores[t, rows, tags[:, t]] -= 1
        g_trans = np.zeros_like(self.p["trans"])
        for t in range(1, size):
            pair = alpha[t - 1][:, :, None] + self.p["trans"] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
            g_trans += np.exp(pair).sum(axis=0)
        np.add.at(g_trans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        grads = {"start": g_start, "trans": g_trans, "bias": flat(d_scores).sum(axis=0)}
        grads["fV"] = flat(forward).T @ flat(d_scores)
        grads["bV"] = flat(backward[::-1]).T @ flat(d_scores)
        grads |= self._back(ids, "f", saved_f, d_scores @ self.p["fV"].T)
        grads |= self._back(ids[:, ::-1], "b", saved_b, (d_scores @ self.p["bV"].T)[::-1])
        return float((total - gold).mean()), {k: v / n for k, v in grads.items()}

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path and the posterior of each of its tags: both (n, size)."""
        scores, _ = self._emissions(ids)
        alpha, beta, total = self._chains(scores)
        posterior = np.exp(alpha + beta - total[None, :, None])
        size, n, _ = scores.shape
        best, came = scores[0] + self.p["start"], np.zeros(scores.shape, dtype=np.int64)
        for t in range(1, size):
            options = best[:, :, None] + self.p["trans"]
            came[t] = options.argmax(axis=1)
            best = scores[t] + options.max(axis=1)
        path = np.zeros((n, size), dtype=np.int64)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = came[t][rows, path[:, t]]
        return path, np.take_along_axis(posterior, path.T[:, :, None], 2)[:, :, 0].T

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.02, seed: int = 2) -> None:
        """Adam steps over shuffled batches."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(ids))])
            now, order = order[:batch], order[batch:]
            _, grads = self.loss(ids[now], tags[now])
            size = np.sqrt(sum((g**2).sum() for g in grads.values()))
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(size, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.p[k] = self.p[k] - slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
