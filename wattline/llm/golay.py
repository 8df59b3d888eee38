"""The binary Golay code (23, 12): every 23-bit word lies within three bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
BITS = 23


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """Index (0 to 4095) of the nearest codeword for each of the 2^23 words, 16 MB."""
    codewords = np.zeros(4096, dtype=np.int32)
    for bit in range(12):
        codewords[np.arange(4096) >> bit & 1 == 1] ^= GENERATOR << bit
    patterns = [0] + [sum(1 << i for i in c) for k in (1, 2, 3) for c in combinations(range(BITS), k)]
    table = np.zeros(1 << BITS, dtype=np.uint16)
    index = np.arange(4096, dtype=np.uint16)
    for e in patterns:
        table[codewords ^ e] = index
    return table


def near_indices(words: np.ndarray, width: int = BITS) -> np.ndarray:
    """(n, 6) codeword indices of each word and of the words one bit away, -1 where there are fewer.

    A word within two bits of its codeword has one; a word three bits away has six at most.
    ``width``: only the lowest so many bits can differ.
    """
    table = decoder()
    near = np.stack([table[words]] + [table[words ^ (1 << b)] for b in range(width)], axis=1).astype(np.int32)
    near.sort(axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    out = np.full((len(words), 6), -1, dtype=np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, col]] = near[row, col]
    return out
