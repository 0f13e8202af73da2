"""Binary Golay code of length 23: nearby codeword indices as fuzzy hash keys.

The code is perfect with covering radius 3: a 23-bit word has one codeword within
distance 3.  A word at distance 3 from it has five more at distance 4, any other
word none.  Two words at distance 1 either decode to the same codeword, or each
is at distance 4 from the other's.  So a word that keeps, beside its own codeword,
those at distance 4 with a smaller index shares a key with every word at distance
0 or 1: the smaller of the two indices.

All tables follow from the generator polynomial.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECK_BITS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a fixed value.
GENERATOR = 0b110001110101
#: Keys of a word at most: its codeword and five others.
MOST_KEYS = 6


def _unit_syndromes() -> np.ndarray:
    """Remainder of every single bit by the generator."""
    out, x = [], 1
    for _ in range(BITS):
        out.append(x)
        x <<= 1
        if x >> CHECK_BITS:
            x ^= GENERATOR
    return np.array(out, np.int64)


UNIT = _unit_syndromes()


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of every word by the generator: 0 for codewords, the same for a word and its error pattern."""
    out = np.zeros(len(words), np.int64)
    for bit in range(BITS):
        out ^= np.where((words >> bit) & 1, UNIT[bit], 0)
    return out


def _patterns(weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error pattern of weight 3 at most, and those of weight 4 (-1 where there is none)."""
    near = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        p = _patterns(weight)
        near[syndromes(p)] = p
    far = np.full((1 << CHECK_BITS, MOST_KEYS - 1), -1, np.int64)
    p = _patterns(4)
    s = syndromes(p)
    order = np.argsort(s, kind="stable")
    s, p = s[order], p[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    three = np.bitwise_count(near[s]) == 3  # nearer words keep their codeword alone
    far[s[three], place[three]] = p[three]
    return near, far


NEAR, FAR = _tables()


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): a word's codeword index, then smaller indices at distance 4; -1 where there is no such key."""
    words = words.astype(np.int64)
    s = syndromes(words)
    own = (words ^ NEAR[s]) >> CHECK_BITS
    others = np.where(FAR[s] >= 0, (words[:, None] ^ FAR[s]) >> CHECK_BITS, -1)
    others[others > own[:, None]] = -1
    return np.concatenate((own[:, None], others), axis=1)
