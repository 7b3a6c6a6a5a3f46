"""Words of whole batches of texts as 64-bit numbers, without a Python step for each word.

A batch is one array of code points. A table maps each code point to its lower-case, look-alike-free form, to nothing
(invisible) or to a break; words are runs between breaks, each Chinese character is a word of its own, and a word's
number is a polynomial sum over its characters. Two words get the same number with a chance of about 2**-64.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from leafmill.llm.lookalikes import Rewriter

TOP = 0x30000
DIVIDED = re.compile(r"(?<=\w)[-‐‑­][ \t]*\r?\n\s*(?=[^\W\d_])")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    number: np.ndarray  # uint64, one a word
    text: np.ndarray  # index of the text it stands in
    han: np.ndarray  # a Chinese character
    start: np.ndarray  # index of its first character in the joined batch
    capital: np.ndarray  # its first letter is upper case
    length: np.ndarray | None = None  # its letters, if asked for


class WordReader:
    """``rewrites``: the look-alike rewrites, usual forms first."""

    def __init__(self, rewrites: dict[str, str]):
        self.table = np.zeros(TOP, np.int32)
        self.upper = np.zeros(TOP, bool)
        for cp in range(TOP):
            ch = chr(cp)
            if 0xD800 <= cp < 0xE000:
                continue
            if ch.isalnum() or unicodedata.category(ch) in ("Mn", "Mc"):
                low = ch.lower()
                self.table[cp] = ord(low) if len(low) == 1 else ord(low[0])
                self.upper[cp] = ch.isupper()
        longer: dict[str, str] = {}
        for s, best in rewrites.items():
            if len(s) == 1 and len(best) <= 1 and ord(s) < TOP:
                if not best:
                    self.table[ord(s)] = -1
                elif ord(best) < TOP:
                    self.table[ord(s)] = self.table[ord(best)]
                    self.upper[ord(s)] = self.upper[ord(best)]
            else:
                longer[s] = best
        self.longer = Rewriter(longer)
        self.value = _mix(np.arange(TOP) + 0x9E3779B9)
        self.value[0] = 0
        self.power = np.ones(64, np.uint64)
        self._powers(64)
        self.is_han = np.zeros(TOP, bool)
        self.is_han[0x3400:0xA000] = True
        self.is_han[0x20000:TOP] = True

    def _powers(self, most: int) -> np.ndarray:
        """The weight of each place in a word, for words of up to ``most`` characters."""
        if most > len(self.power) or self.power[1] == 1:
            step = np.full(max(most, 2 * len(self.power)), np.uint64(0x9E3779B97F4A7C15))
            step[0] = 1
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(step)
        return self.power

    def words(self, texts: list[str], lengths: bool = False) -> Words:
        texts = [self.longer(DIVIDED.sub("", t) if "\n" in t else t) for t in texts]
        joined = "\0".join(texts)
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), TOP - 1)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        c = self.table[points]
        at = None
        if (c < 0).any():
            at = np.flatnonzero(c >= 0)
            c, points = c[at], points[at]
        inside = c > 0
        han = self.is_han[c]
        before = np.empty_like(inside)
        before[0:1] = False
        before[1:] = inside[:-1] & ~han[:-1]
        first = inside & (han | ~before)
        start = np.flatnonzero(first)
        if not len(start):
            none = np.zeros(0, np.int64)
            return Words(none.astype(np.uint64), none, none.astype(bool), none, none.astype(bool), none)
        # position of each character in its word
        pos = np.arange(len(c), dtype=np.int32)
        pos -= np.repeat(start, np.diff(np.append(start, len(c)))).astype(np.int32) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(c))))]).astype(np.int32)
        power = self.power
        if pos.max() >= len(power):
            pos[~inside] = 0  # breaks behind a word are no part of it
            power = self._powers(int(pos.max()) + 1)
        with np.errstate(over="ignore"):
            number = np.add.reduceat(self.value[c] * power[pos], start)
        where = start if at is None else at[start]
        return Words(number, np.searchsorted(ends, where, "right"), han[start], where, self.upper[points[start]], np.add.reduceat(inside.astype(np.int64), start) if lengths else None)


def portions(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch of at most ``most`` characters, or one text: what is held in arrays at a time."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def grams(w: Words, size: int, han_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word n-grams and Chinese character n-grams, each inside one text, and the word they begin at."""
    out_n, out_p = [], []
    for n, kind in ((size, False), (han_size, True)):
        if len(w.number) < n:
            continue
        m = len(w.number) - n + 1
        run = w.text[:m] == w.text[n - 1 :]
        same = np.cumsum(np.concatenate([[0], (w.han == kind)]))
        ok = np.flatnonzero(run & (same[n:] - same[:-n] == n))
        if not len(ok):
            continue
        h = np.full(len(ok), np.uint64(n), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + w.number[ok + k])
        out_n.append(h)
        out_p.append(ok)
    if not out_n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number, pos = np.concatenate(out_n), np.concatenate(out_p)
    order = np.argsort(pos, kind="stable")
    return number[order], pos[order]
