"""Words of texts as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

from .ctph import power_tables

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, so that sums over a word depend on all bits.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) of the texts, one after the other, and where
    each text's words start, with the number of all words at the end."""
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    gap = WHITE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    places = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    return hashes, np.searchsorted(start, places)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row; the last k - 1 places have none. Runs across texts count too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * down[:n])


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; with fewer words, the whole sequence is
    one; without words there is none."""
    hashes, at = hashed_words(raws)
    runs = windows(hashes, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
