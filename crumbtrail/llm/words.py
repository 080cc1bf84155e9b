"""Words of a text: the longest runs of Unicode letters and digits, in lower case, as strings or as 64-bit hashes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: Letters that are hashed at a time, so that the arrays stay in the cache.
LETTERS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache
def is_word() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some texts, each with a line break behind it, and where the texts end."""
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) + 1 for t in texts])


def run_hashes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of stretches of code points: polynomials, read off the running sum over all of them."""
    powers, inverse = _powers(1 << max(16, int(len(codes)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)]
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def slices(texts: list[str], letters: int = LETTERS) -> list[tuple[int, int]]:
    """Stretches of the list with so many letters at most, or one longer text."""
    out, at = [], 0
    while at < len(texts):
        stop, n = at + 1, len(texts[at])
        while stop < len(texts) and n + len(texts[stop]) <= letters:
            n += len(texts[stop])
            stop += 1
        out.append((at, stop))
        at = stop
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some lower-case texts in order, and their text's number."""
    words, number = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in slices(texts):
        codes, ends = codes_of(texts[at:stop])
        edges = np.flatnonzero(np.diff(np.r_[False, is_word()[codes], False]))
        first, last = edges[::2], edges[1::2]
        words.append(run_hashes(codes, first, last))
        number.append(np.searchsorted(ends, first, side="right") + at)
    return np.concatenate(words), np.concatenate(number)
