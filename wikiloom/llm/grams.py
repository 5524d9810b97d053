"""Word hashes and Rabin-Karp hashes of word windows for many texts at once, in numpy.

Words are runs of bytes that are not ASCII white space. A word's hash is the polynomial of its bytes
in an odd base modulo 2**64, mixed with its length; a window's hash is the polynomial of its words'
hashes in the same base, mixed again. Both come from prefix sums, so the cost per byte or word does
not depend on the length of words or windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C55)
_WORD = bytes(int(i not in b" \t\n\x0b\x0c\r") for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        made = []
        for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            powers = np.full(max(n, 2 * _CHUNK), b, np.uint64)
            powers[0] = 1
            made.append(np.cumprod(powers, dtype=np.uint64))
        if n > 4 * _CHUNK:  # a rare very long text; not worth keeping
            return made[0], made[1]
        _POWERS[:] = [(made[0], made[1])]
    return _POWERS[0]


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of ``values[begin:end]`` for each pair; values are multiplied in place."""
    up, down = _powers(len(values) + 1)
    values *= up[: len(values)]
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    return (total[end] - total[begin]) * down[begin]


def _chunk_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = b" " + b" ".join(texts) + b" "
    is_word = np.frombuffer(raw.translate(_WORD), np.uint8)
    edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    begin, end = edges[0::2], edges[1::2]
    data = np.frombuffer(raw.translate(_LOWER) if lower else raw, np.uint8).astype(np.uint64)
    data += np.uint64(1)
    hashes = mix(_sums(data, begin, end) + (end - begin).astype(np.uint64) * BASE)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.diff(np.searchsorted(begin, ends, side="right"), prepend=0)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    a = size = 0
    for b, t in enumerate(texts, 1):
        size += len(t)
        if size >= _CHUNK or b == len(texts):
            yield texts[a:b]
            a, size = b, 0


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one after the other, and the number of words of each.

    ``lower`` reads A to Z as a to z.
    """
    made = [_chunk_words(chunk, lower) for chunk in _chunks(texts)]
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in made]), np.concatenate([n for _, n in made])


def windows_of(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word (among all words) of every window of ``size`` words of one text."""
    windows = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    first = np.cumsum(counts) - counts
    begin = np.arange(len(text)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    out = []
    for a in range(0, len(begin), _CHUNK):  # stretches of words, so that the powers stay few
        at = begin[a : a + _CHUNK]
        low, high = at[0], at[-1] + size
        out.append(mix(_sums(words[low:high].copy(), at - low, at - low + size) + np.uint64(size)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), text, begin
