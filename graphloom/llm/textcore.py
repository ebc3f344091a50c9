"""Vectorised tokenisation: whole batches of text become arrays of word hashes without a Python loop over words.

A word is a maximal run of Unicode letters, numbers and marks of the lower-cased text. Its hash is a polynomial in its
code points modulo 2**64, read off one running sum over the batch, then mixed. Texts are handled in slices of about
``SLICE`` characters, so memory stays small however long a text is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

SLICE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_U = np.uint64


@lru_cache(1)
def word_table() -> np.ndarray:
    """For each code point, whether it is part of a word."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LNM" for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def upper_table() -> np.ndarray:
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


_pow: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of them."""
    if len(_pow[0]) < n:
        m = max(n, 2 * SLICE)
        for k, base in enumerate((_P, _Q)):
            a = np.full(m, base, _U)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=_U)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def codes_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def pieces(text: str, most: int = SLICE) -> Iterator[str]:
    """``text`` in parts of at most ``most`` characters, cut between words; a part that begins with a longer word has all of it."""
    at, table = 0, word_table()
    while len(text) - at > most:
        gaps = np.flatnonzero(~table[codes_of(text[at : at + most + 1])][1:]) + 1
        cut = int(gaps[-1]) if len(gaps) else most + 1
        while not len(gaps) and at + cut < len(text):
            gaps = np.flatnonzero(~table[codes_of(text[at + cut : at + cut + most])])
            cut += int(gaps[0]) if len(gaps) else most
        yield text[at : at + cut]
        at += cut
    yield text[at:]


class Words:
    """Words of the texts lo..hi-1 of a batch: hashes in order, and offsets (hi - lo + 1 of them) by text."""

    __slots__ = ("hashes", "hi", "lengths", "lo", "offsets", "prefixes")

    def __init__(self, lo: int, hi: int, hashes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, prefixes: dict):
        self.lo, self.hi, self.hashes, self.offsets, self.lengths, self.prefixes = lo, hi, hashes, offsets, lengths, prefixes

    @property
    def doc(self) -> np.ndarray:
        """For each word, which text of the slice it belongs to, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.offsets))


def _hash(parts: list[str], prefix_lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Hashes of the words of all parts, words by part, lengths, and hashes of prefixes (0 where a word isn't longer)."""
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    codes = codes_of("\n".join(parts))
    is_word = np.zeros(len(codes) + 2, np.int8)
    is_word[1:-1] = word_table()[codes]
    edge = np.diff(is_word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * power[: len(codes)], out=total[1:])
    back = inverse[start]
    hashes = mix((total[end] - total[start]) * back)
    prefixes = {}
    for n in prefix_lengths:
        stop = np.minimum(start + n, end)
        prefixes[n] = np.where(end - start > n, mix((total[stop] - total[start]) * back), _U(0))
    return hashes, np.diff(np.searchsorted(start, bounds)), end - start, prefixes


def words(texts: Sequence[str | None], prefix_lengths: Sequence[int] = (), most: int = SLICE) -> Iterator[Words]:
    """Slices of whole texts. A null text counts as empty."""
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (not parts or size + len(texts[hi] or "") <= most):
            parts.append((texts[hi] or "").lower())
            size += len(parts[-1]) + 1
            hi += 1
        if len(parts) == 1 and size > most:
            got = [_hash([p], prefix_lengths) for p in pieces(parts[0], most)]
            h = np.concatenate([g[0] for g in got])
            yield Words(lo, hi, h, np.array([0, len(h)]), np.concatenate([g[2] for g in got]), {n: np.concatenate([g[3][n] for g in got]) for n in prefix_lengths})
        else:
            h, counts, lengths, prefixes = _hash(parts, prefix_lengths)
            yield Words(lo, hi, h, np.concatenate([[0], np.cumsum(counts)]), lengths, prefixes)
        lo = hi


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the index of each run's first word."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    g = w.hashes[:m].copy()
    for k in range(1, n):
        g = mix(g * _U(0xD6E8FEB86659FD93) + w.hashes[k : k + m])
    doc = w.doc
    inside = doc[:m] == doc[n - 1 :]
    return g[inside], np.flatnonzero(inside)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    return int(_hash([word.lower()], ())[0][0])


def prefix_hash(prefix: str) -> int:
    """The hash that ``words`` gives words that go on after ``prefix``."""
    return int(_hash([prefix.lower() + "a"], (len(prefix),))[3][len(prefix)][0])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
