"""Modified Kneser-Ney models of order six over bytes, one for each language.

An n-gram is a number: its language above 48 bits, its bytes below. That is a
hash without collisions, so a model is a sorted array of n-grams with the share
that each keeps after its discount, and one of contexts with the weight that
each leaves to the next lower order. Counting is left to Spark; this module
turns texts into n-grams, counts into discounts and cuts, and arrays into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

ORDER = 6
#: Stands before a text; no byte of UTF-8.
BEGIN = 0xFF
LANG_SHIFT = 8 * ORDER
#: Symbols turned into n-grams at a time.
WINDOW = 2 << 20


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of n-grams, of the same language."""
    low = (1 << (8 * order)) - 1
    return (grams & low) | ((grams >> LANG_SHIFT) << LANG_SHIFT)


def context(grams: np.ndarray, order: int) -> np.ndarray:
    """N-grams of ``order`` bytes without their last one."""
    high = (grams >> LANG_SHIFT) << LANG_SHIFT
    return ((grams & ((1 << (8 * order)) - 1)) >> 8) | high


def windows(texts: Sequence[bytes], langs: Sequence[int], size: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams that end at each byte of the texts, and the text of each.

    The texts are walked in stretches of ``size`` bytes, wherever a text ends,
    so one very long text takes no more memory than many short ones.
    """
    pad = bytes([BEGIN]) * (ORDER - 1)
    joined = np.frombuffer(b"".join(p for t in texts for p in (pad, t)), dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + ORDER - 1 for t in texts], dtype=np.int64))
    high = np.array(langs, dtype=np.int64) << LANG_SHIFT
    for lo in range(0, len(joined), size):
        hi = min(len(joined), lo + size)
        back = min(lo, ORDER - 1)
        line = joined[lo - back : hi].astype(np.int64)
        grams = line.copy()
        for i in range(1, ORDER):
            grams[i:] |= line[: max(0, len(line) - i)] << (8 * i)
        text = np.zeros(hi - lo, dtype=np.int64)
        text[ends[(ends > lo) & (ends < hi)] - lo] = 1
        text = np.cumsum(text) + np.searchsorted(ends, lo, "right")
        real = np.flatnonzero(line[back:] != BEGIN)
        text = text[real]
        yield grams[back:][real] | high[text], text


def count(texts: Sequence[bytes], langs: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each stretch of the texts, and how often each occurs."""
    for grams, _ in windows(texts, langs):
        at, found = pd.factorize(grams)
        yield found, np.bincount(at, minlength=len(found))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.9, 2.85), strict=True)]


def least_count(kinds: dict[int, int], most: int) -> int:
    """Least power of two such that ``most`` n-grams or fewer occur as often.

    ``kinds`` has the number of n-grams for each floor(log2(count)).
    """
    kept, least = 0, 1 << (max(kinds, default=0) + 1)
    for power in sorted(kinds, reverse=True):
        kept += kinds[power]
        if kept > most:
            return least
        least = 1 << power
    return 1


@dataclass(frozen=True)
class Model:
    """For each order: sorted n-grams and shares; sorted contexts and weights."""

    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def probability(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probability of the last byte of each n-gram; lower orders are found once for equal suffixes."""
        if not order:
            return np.full(len(grams), 1 / 256)
        at, below = pd.factorize(suffix(grams, order - 1))
        lower = self.probability(below, order - 1)[at]
        i = order - 1
        weight = _looked_up(self.contexts[i], self.weights[i], context(grams, order), 1.0)
        return _looked_up(self.grams[i], self.shares[i], grams, 0.0) + weight * lower


def _looked_up(keys: np.ndarray, values: np.ndarray, of: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(of), missing)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, values[at], missing)


def total_log10(model: Model, texts: Sequence[bytes], langs: Sequence[int]) -> np.ndarray:
    """Sum of log10 probabilities of each text's bytes."""
    out = np.zeros(len(texts))
    for grams, text in windows(texts, langs):
        # In order, equal contexts are neighbours and lookups walk the arrays.
        at, found = pd.factorize(grams, sort=True)
        out += np.bincount(text, weights=np.log10(model.probability(found))[at], minlength=len(texts))
    return out
