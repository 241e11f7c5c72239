"""Hashed word shingles of whole texts, for use inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is a run
of neighbouring words; a text with fewer words is one shingle, and a text
without words has none. Hashes have 64 bits and agree between tasks.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.byte_hash import join, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E6C63D0876A9A47)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(1 << 12)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and the words' starts."""
    global _POWER
    blank = _BLANK[data]
    if blank.all():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    if (longest := int(size.max())) > len(_POWER):
        _POWER = _powers(2 * longest)
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.concatenate((start, [len(data)])))) if start[0] == 0 else None
    if place is None:  # the text begins with blanks: give them the first word's places
        place = np.arange(len(data)) - np.concatenate((np.zeros(start[0], np.int64),
                                                       np.repeat(start, np.diff(np.concatenate((start, [len(data)]))))))
    value = mix(_LOWER[data].astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(place, len(_POWER) - 1)]
    value[blank] = 0
    total = np.add.reduceat(value, start)
    return mix(total + size.astype(np.uint64) * _BASE), start


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, repeats included."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = words[:len(words) - n + 1]
    for i in range(1, n):
        out = join(out, words[i:len(words) - n + 1 + i])
    return mix(out + np.uint64(n))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. Texts are hashed
    together and told apart by their places."""
    if not texts:
        return []
    data = np.frombuffer(b" ".join(texts), np.uint8)
    words, start = word_hashes(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.concatenate(([0], np.searchsorted(start, ends)))
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
