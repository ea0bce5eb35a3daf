"""Statistics of one text, from its UTF-8."""

from __future__ import annotations

from collections import Counter

import numpy as np

from casesignal.llm.common import SPACES

_SPACE = np.array(list(SPACES))
_SYMBOL = np.array(list(b"#*$%&|<>"))
_CONTINUES = np.arange(0x80, 0xC0)
_END = np.array(list(b".,;:!?"))
_DIGIT, _UPPER, _LOWER = np.arange(48, 58), np.arange(65, 91), np.arange(97, 123)
WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)

#: Inputs of the classifier, in order.
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "lower", "digits", "spaces", "ends", "symbols",
    "other_ascii", "beyond_ascii", "entropy", "distinct_words", "top_word", "distinct_triples", "repeated", "dup_lines",
    "log_lines", "line_words", "lines_ended", "words_ended", "capital_words", "symbol_words", "short_words",
)


def histogram(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows found twice or more in the text, first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed += h[i : i + n] * _POWERS[i]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Equal hashes only nominate windows; the words decide.
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    keys = [b" ".join(words[i : i + WINDOW]) for i in at]
    count = Counter(keys)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for i, key in zip(at, keys, strict=True):
        if count[key] > 1:
            steps[i] += 1
            steps[i + WINDOW] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    h = histogram(text)
    chars = int(h.sum() - h[_CONTINUES].sum() - h[_SPACE].sum())
    return len(words), chars, int(h[_SYMBOL].sum()), dup_lines(text), repeat_words(words)


def features(text: bytes) -> list[float]:
    """The values of FEATURES; shares of an empty text are 0."""
    h = histogram(text)
    size = max(1, len(text))
    chars = int(h.sum() - h[_CONTINUES].sum())
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    m = max(1, len(lines))
    p = h[h > 0] / size
    seen = Counter(words)
    tails = Counter([w[-1] for w in words])
    heads = Counter([w[0] for w in words])
    triples = max(1, len(words) - 2)
    named = sum(int(h[x].sum()) for x in (_UPPER, _LOWER, _DIGIT, _SPACE, _END, _SYMBOL))
    return [
        float(np.log1p(chars)),
        float(np.log1p(len(words))),
        float(lengths.sum() / n),
        float(np.log1p(lengths.max(initial=0))),
        float(h[_UPPER].sum() / size),
        float(h[_LOWER].sum() / size),
        float(h[_DIGIT].sum() / size),
        float(h[_SPACE].sum() / size),
        float(h[_END].sum() / size),
        float(h[_SYMBOL].sum() / size),
        float((h[:128].sum() - named) / size),
        float(h[128:].sum() / size),
        float(-(p * np.log2(p)).sum()),
        float(len(seen) / n),
        float(max(seen.values(), default=0) / n),
        float(len(set(zip(words, words[1:], words[2:], strict=False))) / triples),
        float(repeat_words(words) / n),
        float((len(lines) - len(set(lines))) / m),
        float(np.log1p(len(lines))),
        float(np.log1p(len(words) / m)),
        float(sum(x.rstrip(SPACES)[-1:] in (b".", b"!", b"?") for x in lines) / m),
        float(sum(tails[c] for c in b".,;:!?") / n),
        float(sum(heads[c] for c in range(65, 91)) / n),
        float(sum(tails[c] for c in b"#*$%&|<>") / n),
        float((lengths <= 3).sum() / n),
    ]
