"""Words and word shingles of many texts as 64-bit numbers, by numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower
case. A word's number is a polynomial over its bytes, a shingle's one over its
words, both modulo 2**64 and mixed; two different shingles have the same
number with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_M = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_BLANK] = 0
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > 1 << 21:  # a single very long text: not kept
            return out
        _powers[base] = have = out
    return have


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, text after text, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[data]
    before = np.empty_like(blank)
    before[0] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data] * _powers_of(_BASE, len(data))[:len(data)], starts)
        words = mix(sums * _powers_of(_INV, len(data))[starts])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; all words as one shingle where there are fewer."""
    words, first = word_numbers(texts)
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            sums = sum(words[k:len(words) - SHINGLE + 1 + k] * _PLACE[k] for k in range(SHINGLE))
            sums = mix(sums + np.uint64(SHINGLE))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(sums[a:b - SHINGLE + 1]))
            elif b > a:
                one = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([one], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
