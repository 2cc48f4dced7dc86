"""Keys of 23-bit words under the perfect binary Golay code: words at distance 2 or less share a key.

Every word lies within 3 bits of exactly one codeword. The keys of a word are the codewords that it and its 23 neighbours
decode to: one if the word lies within 2 bits of a codeword, else that of its own and five at distance 4. Two words at
distance 2 have a common neighbour (at distance 1 each is the other's), whose codeword is a key of both.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BITS, INFO = 23, 12
#: Fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101
MAX_KEYS = 6


def remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator."""
    words = words.astype(np.int64)
    for bit in range(BITS - 1, BITS - INFO - 1, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - INFO + 1)), words)
    return words


@cache
def leaders() -> np.ndarray:
    """The error of weight 3 or less of each of the 2,048 syndromes."""
    out = np.zeros(1 << (BITS - INFO), dtype=np.int64)
    ones = [0] + [1 << i for i in range(BITS)]
    errors = np.unique([a | b | c for a in ones for b in ones for c in ones])
    out[remainder(errors)] = errors
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword: its 12 leading bits."""
    return (words ^ leaders()[remainder(words)]) >> (BITS - INFO)


@cache
def _offsets() -> np.ndarray:
    """For each syndrome, the keys of a word with that syndrome and leading bits 0; -1 fills up."""
    words = np.arange(1 << (BITS - INFO), dtype=np.int64)
    around = np.stack([decode(words), *(decode(words ^ (1 << i)) for i in range(BITS))], axis=1)
    out = np.full((len(words), MAX_KEYS), -1, dtype=np.int64)
    for i, row in enumerate(around):
        own = np.unique(row)
        out[i, : len(own)] = own
    return out


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of codewords, -1 where a word has fewer."""
    words = words.astype(np.int64)
    rest = remainder(words)
    # Words with one syndrome differ by a codeword, and so do their keys.
    shift = (words ^ rest) >> (BITS - INFO)
    found = _offsets()[rest]
    return np.where(found < 0, -1, found ^ shift[:, None])
