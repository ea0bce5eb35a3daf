"""Token counts by rank-synchronous merging of arrays.

Pre-tokens of a batch lie one after another in one array of symbol ids with
their starts. Each round finds the lowest rank among the pairs of every
pre-token and applies that pair, in all pre-tokens at the same time; a
pre-token without a pair is done, and its surviving symbols are counted.

Texts are cut where no piece of the vocabulary crosses: before a run of spaces,
and around line breaks if no longer piece holds one. Merges never cross such a
cut, so equal pre-tokens are merged once and the counts equal those of the
library on the whole text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

MARK = "▁"
_NONE = np.int64(1) << 40


class BpeCounter:
    """Counts the pieces of a byte-fallback BPE model of the sentencepiece kind."""

    def __init__(self, pieces: list[tuple[str, float]], memory: int = 1_000_000):
        """``pieces``: the normal pieces with their scores, best score first merged."""
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        ranks = np.argsort(np.argsort([-s for _, s in pieces], kind="stable"), kind="stable")
        pairs, merged = [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(i)
        order = np.argsort(pairs)
        self.pairs = np.array(pairs, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int64)[order]
        self.ranks = ranks[self.merged].astype(np.int64)
        inner = {c for p, _ in pieces if len(p) > 1 for c in p}
        self.pattern = re.compile(
            f"{MARK}*[^{MARK}]+|{MARK}+" if "\n" in inner else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
        )
        self.memory, self.known = memory, {}

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a batch's new pre-tokens are merged together."""
        cut = [self.pattern.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = {w for ws in cut for w in ws if w not in known}
        if len(known) + len(new) > self.memory:
            known.clear()
            new = {w for ws in cut for w in ws}
        if new:
            new = list(new)
            known.update(zip(new, self.count(new).tolist(), strict=True))
        return [sum(map(known.__getitem__, ws)) for ws in cut]

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, in arrays of bounded length."""
        out = np.zeros(len(words), dtype=np.int64)
        lo = 0
        while lo < len(words):
            hi, chars = lo, 0
            while hi < len(words) and (hi == lo or chars + len(words[hi]) <= 2_000_000):
                chars += len(words[hi])
                hi += 1
            out[lo:hi] = self._count(words[lo:hi])
            lo = hi
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        """A char's id, or -n for one outside the vocabulary, of n bytes."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, back = np.unique(code, return_inverse=True)
        ids = [self.ids.get(chr(c), -len(chr(c).encode("utf-8", "surrogatepass"))) for c in chars]
        return np.array(ids, dtype=np.int64)[back]

    def _count(self, words: list[str]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        sym = self._symbols(words)
        seq = np.repeat(np.arange(len(words)), lengths)
        sym, seq, again = self._merge(sym, seq, len(words), single=False)
        out = _survivors(sym, seq, len(words))
        if len(again):
            own = [words[i] for i in again]
            sym = self._symbols(own)
            seq = np.repeat(np.arange(len(own)), lengths[again])
            sym, seq, _ = self._merge(sym, seq, len(own), single=True)
            out[again] = _survivors(sym, seq, len(own))
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; an unknown symbol has none."""
        key = (a << 32) | (b & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _merge(self, sym: np.ndarray, seq: np.ndarray, n: int, single: bool):
        """Merge until no pair is left.

        ``single`` applies one occurrence a round, the leftmost, as the library
        does. Otherwise all occurrences of the lowest pair are applied, and the
        pre-tokens where a new pair undercuts it are returned to be done again.
        """
        done_sym, done_seq, again = [], [], []
        while len(sym):
            same = seq[1:] == seq[:-1]
            rank, into = self._rank(sym[:-1], sym[1:])
            rank = np.append(np.where(same, rank, _NONE), _NONE)
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(seq)))
            least = np.repeat(least, sizes)
            live = least < _NONE
            done_sym.append(sym[~live])
            done_seq.append(seq[~live])
            pick = np.flatnonzero(live & (rank == least))
            if not len(pick):
                break
            # Occurrences that overlap: every second one of a run, from the left.
            fresh = np.append(True, (np.diff(pick) > 1) | (np.diff(seq[pick]) > 0))
            run_start = pick[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            pick = pick[(pick - run_start) % 2 == 0]
            if single:
                pick = pick[np.append(True, np.diff(seq[pick]) > 0)]
            before, sym = sym, sym.copy()
            sym[pick] = into[pick]
            keep = live.copy()
            keep[pick + 1] = False
            if not single:
                many = np.unique(seq[pick[1:]][np.diff(seq[pick]) == 0])
                again.append(self._undercut(before, sym, seq, keep, pick[np.isin(seq[pick], many)], least))
            sym, seq = sym[keep], seq[keep]
        again = np.unique(np.concatenate(again)) if again else np.zeros(0, dtype=np.int64)
        return np.concatenate(done_sym or [sym]), np.concatenate(done_seq or [seq]), again

    def _undercut(self, before, sym, seq, keep, pick, least) -> np.ndarray:
        """Pre-tokens where a pair that one of several merges makes is no worse.

        One at a time, from the left, a merged symbol meets the merged symbol
        to its left and the old one to its right.
        """
        if not len(pick):
            return pick
        end = len(sym) - 1
        right = np.minimum(pick + 2, end)
        after, _ = self._rank(sym[pick], before[right])
        low = (pick + 2 <= end) & (seq[right] == seq[pick]) & (after <= least[pick])
        left = np.maximum(pick - 1, 0)
        left = np.where(keep[left], left, np.maximum(left - 1, 0))
        ahead, _ = self._rank(sym[left], sym[pick])
        low |= (left < pick) & (seq[left] == seq[pick]) & (ahead <= least[pick])
        return np.unique(seq[pick][low])


def _survivors(sym: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
    """Known symbols count one token, unknown ones one for each byte."""
    return np.bincount(seq, weights=np.where(sym < 0, -sym, 1), minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def load_counter(model: bytes) -> BpeCounter:
    """The counter of a serialised sentencepiece BPE model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("needs a BPE model with byte fallback that leaves texts as they are")
    normal = [(p.piece, p.score) for p in proto.pieces if p.type == 1]
    if any(MARK in p.lstrip(MARK) for p, _ in normal):
        raise ValueError("a piece holds a space after other characters")
    return BpeCounter(normal)
