"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 12, 20


def symbols(text: str) -> np.ndarray:
    """Class of each character: printable ASCII by itself, then white space, other letters, other digits, all else. 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where((codes >= 33) & (codes < 127), codes - 32, 96).astype(np.int64)
    for at in np.flatnonzero(codes >= 127).tolist():
        c = text[at]
        out[at] = 97 if c.isalpha() else 98 if c.isdigit() else 99 if not c.isspace() else 96
    return out


SYMBOLS = 100


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights and the passes over batches of equally long windows (rows of symbol classes)."""

    def __init__(self, tags: int, seed: int = 0):
        random = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return random.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.tags = tags
        self.p = {"E": random.normal(0, 0.5, (SYMBOLS, EMBED)), "Wo": drawn(2 * HIDDEN, tags), "bo": np.zeros(tags), "T": np.zeros((tags, tags)), "S": np.zeros(tags)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"Wx{d}": drawn(EMBED, 4 * HIDDEN), f"Wh{d}": drawn(HIDDEN, 4 * HIDDEN), f"b{d}": bias}

    def _run(self, emb: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, length, _ = emb.shape
        xs, wh = emb @ self.p[f"Wx{d}"] + self.p[f"b{d}"], self.p[f"Wh{d}"]
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((n, length, HIDDEN))
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = xs[:, t] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, tc, before, old))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        emb = self.p["E"][x]
        return np.concatenate([self._run(emb, "f", None), self._run(emb, "b", None)], axis=2) @ self.p["Wo"] + self.p["bo"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag rows y and its gradient."""
        p, (n, length) = self.p, x.shape
        emb, kept = p["E"][x], {"f": [], "b": []}
        hidden = np.concatenate([self._run(emb, d, kept[d]) for d in "fb"], axis=2)
        e = hidden @ p["Wo"] + p["bo"]
        rows = np.arange(n)
        alpha = np.empty((length, n, self.tags))
        alpha[0] = p["S"] + e[:, 0]
        for t in range(1, length):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + p["T"], 1) + e[:, t]
        total = _logsumexp(alpha[-1], 1)
        beta, de, dt = np.zeros((n, self.tags)), np.empty_like(e), np.zeros_like(p["T"])
        gold = p["S"][y[:, 0]] + e[rows, 0, y[:, 0]]
        for t in range(length - 1, -1, -1):
            de[:, t] = np.exp(alpha[t] + beta - total[:, None])
            if t:
                gold += p["T"][y[:, t - 1], y[:, t]] + e[rows, t, y[:, t]]
                joint = alpha[t - 1][:, :, None] + p["T"] + (e[:, t] + beta)[:, None, :] - total[:, None, None]
                dt += np.exp(joint).sum(axis=0)
                np.add.at(dt, (y[:, t - 1], y[:, t]), -1.0)
                beta = _logsumexp(p["T"] + (e[:, t] + beta)[:, None, :], 2)
        de[rows[:, None], np.arange(length), y] -= 1
        g = {"T": dt, "S": de[:, 0].sum(axis=0), "Wo": np.einsum("nth,ntk->hk", hidden, de), "bo": de.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        dh_all, demb = de @ p["Wo"].T, np.zeros_like(emb)
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            dwh, dz_all = np.zeros_like(p[f"Wh{d}"]), np.empty((n, length, 4 * HIDDEN))
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, i, f, o, gg, tc, before, old in reversed(kept[d]):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                dz_all[:, t] = dz
                dwh += before.T @ dz
                dh, dc = dz @ p[f"Wh{d}"].T, dc * f
            g |= {f"Wh{d}": dwh, f"Wx{d}": np.einsum("nte,ntz->ez", emb, dz_all), f"b{d}": dz_all.sum(axis=(0, 1))}
            demb += dz_all @ p[f"Wx{d}"].T
        np.add.at(g["E"], x, demb)
        return float((total - gold).mean()), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam with clipped gradients; the mean loss of each epoch."""
        random, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order, seen = random.permutation(len(x)), []
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                loss, g = self.loss(x[own], y[own])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 5 / (norm + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * w, 0.999 * v[k] + 0.001 * w**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, scores: list[np.ndarray], block: int = 256) -> list[np.ndarray]:
        """Best tag sequence of each sequence of emission scores; sequences of like length are decoded together."""
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        for at in range(0, len(order), block):
            own = order[at : at + block]
            length = len(scores[own[-1]])
            e = np.zeros((len(own), length, self.tags))
            for row, i in enumerate(own):
                e[row, : len(scores[i])] = scores[i]
            best, back = self.p["S"] + e[:, 0], np.zeros((length, len(own), self.tags), np.int8)
            ends = np.array([len(scores[i]) for i in own])
            final = best.copy()
            for t in range(1, length):
                step = best[:, :, None] + self.p["T"]
                back[t] = step.argmax(axis=1)
                best = step.max(axis=1) + e[:, t]
                final[ends > t] = best[ends > t]
            for row, i in enumerate(own):
                tag, path = int(final[row].argmax()), np.empty(ends[row], np.int64)
                for t in range(ends[row] - 1, -1, -1):
                    path[t] = tag
                    tag = int(back[t, row, tag])
                out[i] = path
        return out
