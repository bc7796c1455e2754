"""Minimisers of sliding windows over hash arrays."""

from __future__ import annotations

import numpy as np

WORD = 2**64
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# One random odd number per byte value and per place in a word, made by the mixing rule. The
# blank counts nothing, so words hash alike wherever they stand.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
PLACE = mix(np.arange(1, _STEPS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
WORD_BYTE = BYTE.copy()
WORD_BYTE[32] = 0


def word_hashes(joined: bytes, starts: np.ndarray) -> np.ndarray:
    """A hash per word of a text whose words are joined by single blanks and begin at ``starts``."""
    data = np.frombuffer(joined, np.uint8)
    inside = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return mix(np.add.reduceat(WORD_BYTE[data] * PLACE[inside % _STEPS], starts))


def word_grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash per run of n words."""
    count = len(words) - n + 1
    return mix(sum(words[k:k + count] * PLACE[k] for k in range(n)))


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash per run of n bytes, n a power of two: hashes of halves are joined, so no table grows with the text."""
    h, width = BYTE[data], 1
    while width < n:
        h = h[:-width] * PLACE[width] + h[width:]
        width *= 2
    return mix(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least hash of every ``width`` consecutive ones."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the maximal runs of equal values."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:]))


def blocks(h: np.ndarray, least: np.uint64, start: int, stop: int, width: int, block: int) -> list[tuple[int, int, int]]:
    """Parts (from, to, place) of a run of windows that share their least hash.

    ``place`` is how far the last window's first such hash lies behind its start; it grows by one
    per window towards the front. A part ends where it does not, or where it enters another
    block of ``block`` places.
    """
    at = start + np.flatnonzero(h[start:stop - 1 + width] == least)
    windows = np.arange(start, stop)
    place = at[np.searchsorted(at, windows)] - windows
    cut = np.flatnonzero((place[1:] != place[:-1] - 1) | (place[1:] // block != place[:-1] // block)) + 1
    edges = [0, *cut.tolist(), len(place)]
    return [(start + a, start + b, int(place[b - 1])) for a, b in zip(edges, edges[1:])]
