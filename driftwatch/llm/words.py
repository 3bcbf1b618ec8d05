"""Words and shingles of whole texts as arrays of 64-bit hashes.

A word is a maximal run without the six ASCII white-space bytes, with A-Z lower-cased. Its hash is the sum of its
bytes' numbers, each times a number of its place, modulo 2**64, then mixed. The places' numbers follow no rule: with
powers of one base, regular long words would meet. Equal words have equal hashes everywhere, and among ten million
different words the chance of any collision is about 3 in a million. Long texts are hashed in runs that end at white space, so memory
follows the number of words, not the bytes times a constant.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

RUN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_WEIGHT = [mix(np.arange(5001, 6025, dtype=np.uint64)) | np.uint64(1)]


def _weights(n: int) -> np.ndarray:
    """Odd multipliers of the first ``n`` places of a word, without any rule that words could follow."""
    if len(_WEIGHT[0]) < n:
        _WEIGHT[0] = mix(np.arange(5001, 5001 + max(n, 2 * len(_WEIGHT[0])), dtype=np.uint64)) | np.uint64(1)
    return _WEIGHT[0]


def spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, text number and hash of every word. ``data`` holds the texts, ``cuts`` their offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sep = SPACE[data]
    first = ~sep
    last = first.copy()
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[1:] &= sep[:-1]
    first[inner] = ~sep[inner]
    last[:-1] &= sep[1:]
    last[inner - 1] = ~sep[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + RUN, side="right")))
        a, b = starts[low], ends[high - 1]
        own = starts[low:high]
        place = np.arange(a, b) - np.repeat(own, np.diff(own, append=b))
        value = _BYTE[LOWER[data[a:b]]]
        value[sep[a:b]] = 0
        value *= _weights(int(place.max()) + 1)[place]
        hashes[low:high] = np.add.reduceat(value, own - a)
        low = high
    texts = np.searchsorted(cuts, starts, side="right") - 1
    return starts, ends, texts, mix(hashes)


def shingle_sets(data: np.ndarray, cuts: np.ndarray, width: int = 5):
    """For each text in order its distinct ``width``-word shingles, sorted; a shorter text is one shingle, no word none."""
    _, _, texts, words = spans(data, cuts)
    bounds = np.searchsorted(texts, np.arange(len(cuts)))
    grams = np.zeros(0, np.uint64)
    if len(words) >= width:
        grams = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            grams += words[k : len(words) - width + 1 + k] * _PLACE[k]
        grams = mix(grams)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            yield np.unique(grams[low : high - width + 1])
        elif high > low:
            yield mix((words[low:high] * _PLACE[: high - low]).sum(keepdims=True) ^ _PLACE[high - low])
        else:
            yield np.zeros(0, np.uint64)
