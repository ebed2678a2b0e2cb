"""A character-level bidirectional LSTM with CRF transitions, trained and applied in numpy on windows of equal length."""

from __future__ import annotations

import numpy as np

#: Character classes: ASCII as it is, other letters, other characters, padding.
LETTER, OTHER, PAD, CLASSES = 128, 129, 130, 131
#: What takes a tag out of all sequences.
BARRED = np.float32(1e4)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 128, points, OTHER)
    far = np.flatnonzero(points >= 128)
    if len(far):
        out[far[np.fromiter((text[i].isalpha() for i in far.tolist()), bool, len(far))]] = LETTER
    return out.astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Weights by name: per direction the input table (one row of gate inputs per character class), recurrent weights; then output and transitions."""

    def __init__(self, tags: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.w = {}
        for d in "fb":
            self.w[f"in_{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden)).astype(np.float32)
            self.w[f"in_{d}"][:, hidden : 2 * hidden] += 1  # open forget gates
            self.w[f"rec_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.2, (2 * hidden, tags)).astype(np.float32)
        self.w["bias"] = np.zeros(tags, np.float32)
        self.w["trans"] = np.zeros((tags, tags), np.float32)
        self.w["start"] = np.zeros(tags, np.float32)

    def _pass(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of one direction, and what the way back needs."""
        n, length = x.shape
        table, rec, size = self.w[f"in_{d}"], self.w[f"rec_{d}"], self.hidden
        h, c, kept = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), []
        out = np.zeros((length, n, size), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
            before, last = c, h
            c = f * before + i * g
            shown = np.tanh(c)
            h = o * shown
            out[t] = h
            kept.append((t, i, f, o, g, before, last, shown))
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        """(time, batch, tags) scores, and the states they come from."""
        ahead, kept_ahead = self._pass(x, "f")
        back, kept_back = self._pass(x, "b")
        both = np.concatenate([ahead, back], axis=2)
        return both @ self.w["out"] + self.w["bias"], both, kept_ahead, kept_back

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences (batch, time), by Viterbi over all windows at once, and the chance of each of their tags over all sequences."""
        scores = self.emissions(x)[0]
        length, n, tags = scores.shape
        best, came = self.w["start"] + scores[0], np.zeros((length, n, tags), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + self.w["trans"][None]
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        out, sure = np.zeros((n, length), np.int8), np.ones((n, length), np.float32)
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(n), out[:, t]]
        some = np.flatnonzero(out.any(axis=1))
        if len(some):
            a, b = self._sums(scores[:, some])
            chances = np.exp(a + b - _logsum(a[-1], 1)[None, :, None])
            sure[some] = np.take_along_axis(chances, out[some].T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T
        return out, sure

    def _sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all ways to and from each tag."""
        length, trans = len(scores), self.w["trans"]
        a, b = np.zeros_like(scores), np.zeros_like(scores)
        a[0] = self.w["start"] + scores[0]
        for t in range(1, length):
            a[t] = _logsum(a[t - 1][:, :, None] + trans[None], 1) + scores[t]
        for t in range(length - 2, -1, -1):
            b[t] = _logsum(trans[None] + (scores[t + 1] + b[t + 1])[:, None, :], 2)
        return a, b

    def gradient(self, x: np.ndarray, y: np.ndarray, known: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y under the CRF, and its gradient.

        Where `known` is false a tag says nothing: the likelihood is then that of all sequences that agree with the known tags.
        """
        scores, both, kept_ahead, kept_back = self.emissions(x)
        length, n, tags = scores.shape
        trans, rows = self.w["trans"], np.arange(n)
        a, b = self._sums(scores)
        total = _logsum(a[-1], 1)
        d_scores = np.exp(a + b - total[None, :, None])
        d_trans, d_start = np.zeros_like(trans), d_scores[0].sum(axis=0)
        for t in range(1, length):
            d_trans += np.exp(a[t - 1][:, :, None] + trans[None] + (scores[t] + b[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        if known is None or known.all():
            gold = self.w["start"][y[:, 0]] + scores[0][rows, y[:, 0]]
            for t in range(1, length):
                gold = gold + trans[y[:, t - 1], y[:, t]] + scores[t][rows, y[:, t]]
                np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
            np.add.at(d_start, y[:, 0], -1)
            d_scores[np.arange(length)[:, None], rows[None], y.T] -= 1
        else:
            others = known.T[:, :, None] & (np.arange(tags)[None, None] != y.T[:, :, None])
            held = np.where(others, scores - BARRED, scores).astype(scores.dtype)
            a, b = self._sums(held)
            gold = _logsum(a[-1], 1)
            agreeing = np.exp(a + b - gold[None, :, None])
            d_start = d_start - agreeing[0].sum(axis=0)
            for t in range(1, length):
                d_trans -= np.exp(a[t - 1][:, :, None] + trans[None] + (held[t] + b[t])[:, None, :] - gold[:, None, None]).sum(axis=0)
            d_scores = d_scores - agreeing
        g = {"start": d_start, "trans": d_trans, "bias": d_scores.sum(axis=(0, 1)), "out": both.reshape(-1, both.shape[2]).T @ d_scores.reshape(-1, tags)}
        d_both = d_scores @ self.w["out"].T
        size = self.hidden
        for d, kept, d_h in (("f", kept_ahead, d_both[:, :, :size]), ("b", kept_back, d_both[:, :, size:])):
            rec, g_in, g_rec = self.w[f"rec_{d}"], np.zeros((CLASSES, 4 * size), np.float32), np.zeros((size, 4 * size), np.float32)
            h_next, c_next = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
            for t, i, f, o, c_in, before, last, shown in reversed(kept):
                h_all = d_h[t] + h_next
                c_all = c_next + h_all * o * (1 - shown**2)
                z = np.concatenate([c_all * c_in * i * (1 - i), c_all * before * f * (1 - f), h_all * shown * o * (1 - o), c_all * i * (1 - c_in**2)], axis=1)
                g_in += (x[:, t, None] == np.arange(CLASSES)).astype(np.float32).T @ z
                g_rec += last.T @ z
                h_next, c_next = z @ rec.T, c_all * f
            g[f"in_{d}"], g[f"rec_{d}"] = g_in, g_rec
        return float((total - gold).mean()), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.03, seed: int = 11, known: np.ndarray | None = None) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch. `known` as in `gradient`."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            order, lost = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, g = self.gradient(x[part], y[part], None if known is None else known[part])
                step += 1
                lost.append(loss)
                scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((v**2).sum() for v in g.values())))))
                for k, v in g.items():
                    v = v * scale
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v**2
                    move = rate * (0.5 if epoch > epochs // 2 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.w[k] = (self.w[k] - move).astype(np.float32)
            losses.append(float(np.mean(lost)))
        return losses
