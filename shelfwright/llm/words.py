"""Hashes of the words of many texts at once, and of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bloom import mix

#: Bytes of text handled at once (a longer text by itself).
BLOCK = 8_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240611)
LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(256, BASE, np.uint64))


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate((_powers, _powers * _powers[-1]))
    return _powers


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of the texts of about BLOCK bytes, with the number of the first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of all texts in a row, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[raw]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(raw) and not space[0]:
        starts = np.concatenate(([0], starts))
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    word = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
    place = np.arange(len(raw)) - starts[np.maximum(word, 0)]
    place[space] = 0
    value = LETTER[raw] * powers(int(place.max()) + 1)[place]
    value[space] = 0
    return mix(np.add.reduceat(value, starts)), counts


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return out
