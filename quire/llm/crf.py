"""A linear-chain conditional random field in numpy: scores are sums of table look-ups, so that training and decoding run over whole batches."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Crf:
    """codes: (sentences, length, features) numbers of features, each feature with a table of its own size; tags below `tags`."""

    def __init__(self, sizes: list[int], tags: int) -> None:
        self.sizes, self.tags = sizes, tags
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.table = np.zeros((int(np.sum(sizes)), tags), np.float32)
        self.step = np.zeros((tags, tags), np.float32)
        self.first = np.zeros(tags, np.float32)
        self.last = np.zeros(tags, np.float32)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((*codes.shape[:-1], self.tags), np.float32)
        for f in range(codes.shape[-1]):
            out += self.table[self.starts[f] + codes[..., f]]
        return out

    def fit(self, codes: np.ndarray, gold: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.08, decay: float = 2e-4) -> Crf:
        """Maximum likelihood with a quadratic penalty, by Adam over all sentences at once."""
        n, t = gold.shape
        k = self.tags
        mask = np.arange(t)[None, :] < lengths[:, None]
        rows = (self.starts[None, None, :] + codes)[mask]
        flat, inverse = np.unique(rows, return_inverse=True)
        inverse = inverse.reshape(rows.shape)
        own = np.zeros((*gold.shape, k), np.float32)
        np.put_along_axis(own, gold[..., None], 1.0, axis=2)
        own *= mask[..., None]
        last = lengths - 1
        parts = {"table": self.table[flat], "step": self.step, "first": self.first, "last": self.last}
        m = {a: np.zeros_like(p) for a, p in parts.items()}
        v = {a: np.zeros_like(p) for a, p in parts.items()}
        pair_gold = np.zeros((k, k))
        both = mask[:, 1:]
        np.add.at(pair_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        for r in range(1, rounds + 1):
            e = np.zeros((n, t, k), np.float32)
            e[mask] = parts["table"][inverse].sum(axis=1)
            a = np.zeros((n, t, k), np.float32)
            b = np.zeros((n, t, k), np.float32)
            a[:, 0] = e[:, 0] + parts["first"]
            for i in range(1, t):
                x = _lse(a[:, i - 1, :, None] + parts["step"], 1) + e[:, i]
                a[:, i] = np.where(mask[:, i, None], x, a[:, i - 1])
            b[np.arange(n), last] = parts["last"]
            for i in range(t - 2, -1, -1):
                x = _lse(parts["step"][None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
                b[:, i] = np.where((i < last)[:, None], x, b[:, i])
            z = _lse(a[np.arange(n), last] + parts["last"], 1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            diff = (own - p)[mask].astype(np.float32)
            g = {"table": np.zeros_like(parts["table"])}
            for f in range(inverse.shape[1]):
                for c in range(k):
                    g["table"][:, c] += np.bincount(inverse[:, f], weights=diff[:, c], minlength=len(flat)).astype(np.float32)
            pair = np.zeros((k, k))
            for i in range(1, t):
                x = a[:, i - 1, :, None] + parts["step"] + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None]
                pair += (np.exp(x) * mask[:, i, None, None]).sum(axis=0)
            g["step"] = (pair_gold - pair).astype(np.float32)
            g["first"] = (own[:, 0] - p[:, 0]).sum(axis=0).astype(np.float32)
            g["last"] = (own[np.arange(n), last] - p[np.arange(n), last]).sum(axis=0).astype(np.float32)
            for name, x in parts.items():
                d = g[name] / n - decay * x
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                parts[name] = (x + rate * (m[name] / (1 - 0.9**r)) / (np.sqrt(v[name] / (1 - 0.99**r)) + 1e-8)).astype(np.float32)
        self.table[flat] = parts["table"]
        self.step, self.first, self.last = parts["step"], parts["first"], parts["last"]
        return self

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of each sentence, over a batch padded to one length. Sentences lie along the last axis, so that each step is a few operations on whole rows."""
        n, t, k = scores.shape
        s = np.ascontiguousarray(scores.transpose(1, 2, 0))
        step = self.step[:, :, None]
        best = s[0] + self.first[:, None]
        back = np.zeros((t, k, n), np.int8)
        short = int(lengths.min()) if n else 0
        for i in range(1, t):
            most, arg = best[0] + step[0], back[i]
            for a in range(1, k):
                x = best[a] + step[a]
                np.copyto(arg, a, where=x > most)
                np.maximum(most, x, out=most)
            most += s[i]
            best = most if i < short else np.where(i < lengths, most, best)
        out = np.zeros((n, t), np.int8)
        now = (best + self.last[:, None]).argmax(axis=0)
        who = np.arange(n)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            out[inside, i] = now[inside]
            now = np.where(inside & (i > 0), back[i, now, who], now)
        return out
