"""A linear-chain conditional random field in numpy, for short sequences in large batches."""

from __future__ import annotations

from collections import Counter

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Crf:
    """Features are strings; those of the sample that occur ``least`` times have weights, others are ignored."""

    def __init__(self, tags: int):
        self.tags = tags
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, tags))
        self.move = np.zeros((tags, tags))

    # -- arrays -------------------------------------------------------------------------------------------------
    def encode(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature numbers, step they belong to, steps of each sequence); steps are numbered through all sequences."""
        get = self.index.get
        ids, owner, step = [], [], 0
        for seq in sequences:
            for features in seq:
                own = [k for f in features if (k := get(f)) is not None]
                ids += own
                owner += [step] * len(own)
                step += 1
        return np.array(ids, np.int64), np.array(owner, np.int64), np.array([len(s) for s in sequences], np.int64)

    def _emissions(self, ids: np.ndarray, owner: np.ndarray, steps: int) -> np.ndarray:
        out = np.empty((steps, self.tags))
        for t in range(self.tags):
            out[:, t] = np.bincount(owner, self.weight[ids, t], steps)
        return out

    @staticmethod
    def _padded(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longest = int(size.max())
        mask = np.arange(longest) < size[:, None]
        out = np.zeros((len(size), longest, flat.shape[1]))
        out[mask] = flat
        return out, mask

    # -- fitting ------------------------------------------------------------------------------------------------
    def fit(self, sequences: list[list[list[str]]], labels: list[list[int]], epochs: int = 12, batch: int = 256, rate: float = 0.08, decay: float = 1e-5, least: int = 2, seed: int = 7) -> Crf:
        count = Counter(f for seq in sequences for features in seq for f in features)
        self.index = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
        self.weight = np.zeros((len(self.index), self.tags))
        gw, gm = np.full_like(self.weight, 1e-3), np.full_like(self.move, 1e-3)
        order = np.random.default_rng(seed)
        data = [(self.encode([s]), np.array(y)) for s, y in zip(sequences, labels) if s]
        for _ in range(epochs):
            perm = order.permutation(len(data))
            for lo in range(0, len(perm), batch):
                part = [data[k] for k in perm[lo : lo + batch]]
                size = np.array([int(e[2][0]) for e, _ in part])
                offset = np.concatenate([[0], np.cumsum(size)])
                ids = np.concatenate([e[0] for e, _ in part])
                owner = np.concatenate([e[1] + o for (e, _), o in zip(part, offset)])
                gold = np.concatenate([y for _, y in part])
                d_emit, d_move = self._gradient(ids, owner, size, gold)
                d_weight = np.zeros_like(self.weight)
                for t in range(self.tags):
                    d_weight[:, t] = np.bincount(ids, d_emit[owner, t], len(self.weight))
                d_weight -= decay * self.weight
                gw += d_weight**2
                gm += d_move**2
                self.weight += rate * d_weight / np.sqrt(gw)
                self.move += rate * d_move / np.sqrt(gm)
        return self

    def _gradient(self, ids: np.ndarray, owner: np.ndarray, size: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = int(size.sum())
        emit, mask = self._padded(self._emissions(ids, owner, steps), size)
        n, longest, k = emit.shape
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = emit[:, t] + _logsumexp(forward[:, t - 1, :, None] + self.move, 1)
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsumexp(self.move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        total = _logsumexp(forward[:, -1], 1)
        gold_padded = np.zeros((n, longest), np.int64)
        gold_padded[mask] = gold
        prob = np.exp(forward + backward - total[:, None, None])
        d_emit = (np.eye(k)[gold_padded] - prob)[mask]
        d_move = np.zeros_like(self.move)
        for t in range(1, longest):
            live = mask[:, t]
            if live.any():
                both = forward[live, t - 1, :, None] + self.move + (emit[live, t] + backward[live, t])[:, None, :] - total[live, None, None]
                d_move -= np.exp(both).sum(0)
                np.add.at(d_move, (gold_padded[live, t - 1], gold_padded[live, t]), 1)
        return d_emit, d_move

    # -- decoding -----------------------------------------------------------------------------------------------
    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best tags of each sequence."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        by_length = sorted((k for k in range(len(sequences)) if sequences[k]), key=lambda k: len(sequences[k]))
        for lo in range(0, len(by_length), 2000):  # of similar length, so that little is padded
            part = by_length[lo : lo + 2000]
            ids, owner, size = self.encode([sequences[k] for k in part])
            emit, mask = self._padded(self._emissions(ids, owner, int(size.sum())), size)
            n, longest, _ = emit.shape
            best, back = emit[:, 0].copy(), np.zeros((n, longest, self.tags), np.int64)
            for t in range(1, longest):
                options = best[:, :, None] + self.move
                back[:, t] = options.argmax(1)
                best = np.where(mask[:, t, None], options.max(1) + emit[:, t], best)
            tag = best.argmax(1)
            tags = np.zeros((n, longest), np.int64)
            rows = np.arange(n)
            for t in range(longest - 1, -1, -1):
                live = mask[:, t]
                tags[live, t] = tag[live]
                tag = np.where(live & (t > 0), back[rows, t, tag], tag)
            for row, k in enumerate(part):
                out[k] = tags[row, : size[row]]
        return out
