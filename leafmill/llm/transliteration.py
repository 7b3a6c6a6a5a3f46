"""How names are written in Chinese: a many-to-many model of letter groups and characters, learned from a glossary.

Each pair (name, characters) is cut into groups of 1 to 5 letters against 1 or 2 characters; expectation-maximisation
over all cuts gives the probability of each pair of groups. A name of the text is then written by its most
probable cut. The model is small: its size follows the syllables of the names and not the number of names.
"""

from __future__ import annotations

import math
from collections import defaultdict

MOST_LETTERS, MOST_CHARS = 5, 2
LONGEST = 64  # letters of a name of the sample that the model is fitted on; names of any length are written
ROUNDS = 8
FLOOR = 1e-4


class Transliterator:
    def __init__(self, table: dict[str, list[tuple[str, float]]]):
        self.table = table
        self.known: dict[str, tuple[str, float]] = {}

    @classmethod
    def fit(cls, pairs: list[tuple[str, str]]) -> Transliterator:
        pairs = sorted({(a.lower(), b) for a, b in pairs if a and b and 2 <= len(b) <= len(a) <= LONGEST})
        prob: dict[tuple[str, str], float] = defaultdict(lambda: 1.0)
        for k in range(ROUNDS):
            count: dict[tuple[str, str], float] = defaultdict(float)
            for a, b in pairs:
                cls._expect(a, b, prob, count, 0.3 if k < ROUNDS - 3 else 1.0)
            # joint probabilities: a long group that is seldom can't win over the short ones it is made of
            total = sum(count.values()) or 1.0
            prob = defaultdict(lambda: 1e-12, {xy: n / total for xy, n in count.items() if n > 1e-3})
        table: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for (x, y), p in prob.items():
            table[x].append((y, math.log(p)))
        return cls({x: [max(ys, key=lambda e: (e[1], e[0]))] for x, ys in table.items()})  # no other can be in a most probable cut

    @staticmethod
    def _expect(a: str, b: str, prob: dict[tuple[str, str], float], count: dict[tuple[str, str], float], shrink: float) -> None:
        n, m = len(a), len(b)
        forward = [[0.0] * (m + 1) for _ in range(n + 1)]
        backward = [[0.0] * (m + 1) for _ in range(n + 1)]
        forward[0][0] = backward[n][m] = 1.0
        edges = [(i, j, di, dj) for i in range(n) for j in range(m) for di in range(1, min(MOST_LETTERS, n - i) + 1) for dj in range(1, min(MOST_CHARS, m - j) + 1)]
        weight = {(i, j, di, dj): prob[a[i : i + di], b[j : j + dj]] * shrink ** (di + dj - 2) for i, j, di, dj in edges}
        for i, j, di, dj in edges:
            if forward[i][j]:
                forward[i + di][j + dj] += forward[i][j] * weight[i, j, di, dj]
        for i, j, di, dj in reversed(edges):
            backward[i][j] += backward[i + di][j + dj] * weight[i, j, di, dj]
        if not (all_of := forward[n][m]):
            return
        for i, j, di, dj in edges:
            p = forward[i][j] * weight[i, j, di, dj] * backward[i + di][j + dj] / all_of
            if p > 1e-6:
                count[a[i : i + di], b[j : j + dj]] += p

    def write(self, name: str) -> tuple[str, float]:
        """The most probable characters and the mean logarithm of probability a letter; ('', -inf) if there are none."""
        name = name.lower()
        if name in self.known:
            return self.known[name]
        n = len(name)
        best: list[tuple[float, str]] = [(-math.inf, "")] * (n + 1)
        best[0] = (0.0, "")
        for i in range(n):
            score, text = best[i]
            if score == -math.inf:
                continue
            for d in range(1, min(MOST_LETTERS, n - i) + 1):
                for chars, p in self.table.get(name[i : i + d], ()):
                    s = score + p
                    if s > best[i + d][0]:
                        best[i + d] = (s, text + chars)
        score, text = best[n]
        out = (text, score / max(n, 1)) if score > -math.inf else ("", -math.inf)
        if len(self.known) < 200_000:
            self.known[name] = out
        return out
