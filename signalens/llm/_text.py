"""Vectorised text primitives shared by the operators that need token or character streams.

A word is a maximal run of letters and digits (Unicode categories L and N), lower-cased one code point at a time.
Everything here works on whole texts: a text of any length is cut only between words, and a word is never cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters handled at once; it bounds the memory of a Python worker, not what is read.
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: The same words as ``words()``, as a regular expression that Java and RE2 read alike.
WORD_PATTERN = r"[\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it part of a word, and its lower case (itself if that isn't one code point)."""
    n = sys.maxunicode + 1
    word = np.zeros(n, dtype=bool)
    lower = np.arange(n, dtype=np.uint32)
    for cp in range(n):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LN":
            word[cp] = True
            low = c.lower()
            if len(low) == 1 and low != c:
                lower[cp] = ord(low)
    return word, lower


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _BASE, _INV
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash_words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one stream of code points."""
    word, lower = _tables()
    inside = word[cps]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    size = 1 << max(16, int(len(cps)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.cumsum((lower[cps].astype(np.uint64) + np.uint64(1)) * up[: len(cps)], dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        h = (total[end - 1] - before) * down[start] + (end - start).astype(np.uint64)
    return mix(h), start.astype(np.int64), end.astype(np.int64)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces of about CHUNK characters, cut in front of a character that is in no word."""
    word, _ = _tables()
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and word[ord(text[to])]:
            to += 1
        yield at, text[at:to]
        at = to


def words(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of many texts, in groups of about CHUNK characters.

    Yields (first, last, offsets, hash, start, end): the words of texts[first:last]; those of text first+i are
    offsets[i]:offsets[i+1]; start and end count characters from the start of their own text. A null text has no words.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "") + 1
            j += 1
        group = [t or "" for t in texts[i:j]]
        if len(group) == 1 and len(group[0]) > CHUNK:
            parts = [(at, *_hash_words(code_points(p))) for at, p in _pieces(group[0])]
            h = np.concatenate([p[1] for p in parts])
            start = np.concatenate([p[2] + p[0] for p in parts])
            end = np.concatenate([p[3] + p[0] for p in parts])
            yield i, j, np.array([0, len(h)]), h, start, end
        else:
            h, start, end = _hash_words(code_points("\n".join(group) + "\n"))
            lengths = np.array([len(t) + 1 for t in group], dtype=np.int64)
            begins = np.concatenate([[0], np.cumsum(lengths)])
            offsets = np.searchsorted(start, begins)
            shift = np.repeat(begins[:-1], np.diff(offsets))
            yield i, j, offsets, h, start - shift, end - shift
        i = j


_STEP = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; run i starts at word i."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + m]) * _STEP[i % len(_STEP)]
            out ^= out >> np.uint64(29)
    return mix(out)


def gram_sets(texts: Sequence[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words; of a text of fewer words, that of all of them; of a
    text without words, none."""
    for i, j, off, h, _, _ in words(texts):
        g = grams(h, n)
        for k in range(j - i):
            a, b = off[k], off[k + 1]
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield grams(h[a:b], int(b - a))
            else:
                yield g[:0]
