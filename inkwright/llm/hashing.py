"""Vectorised word and shingle hashes of whole texts, as numpy arrays over UTF-8 bytes.

Texts are joined with a separator and handled about CHUNK bytes at a time (a longer text is one chunk), so
memory is bounded by the longest text. Word hashes are polynomial in the word's bytes modulo 2^64,
taken from one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps)
    return _tables[0][:n], _tables[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which window() takes the hash of any part of data."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=out[1:])
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _powers(len(sums))[1][start])


#: For each byte value: 1 if it parts words.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Position of the first text, then the texts of a chunk as bytes."""
    first, held, size = 0, [], 0
    for text in texts:
        raw = b"" if text is None else text.encode()
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = first + len(held), [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


class Words:
    """Words of a chunk: hash, and the text (position in the chunk) that each belongs to, in order."""

    def __init__(self, raw: list[bytes], parts: np.ndarray = SPACES, lower: bool = True):
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            data = _LOWER[data]
        inside = ~parts[data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.sums = running(data)
        self.hash = window(self.sums, self.start, self.end)
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.text = np.searchsorted(ends, self.start, "right")
        #: first word of each text, and one past the last of all
        self.first = np.searchsorted(self.text, np.arange(len(raw) + 1))
        self.offset = ends - [len(x) + 1 for x in raw]

    def __len__(self) -> int:
        return len(self.hash)


def shingle_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles; fewer words: the whole sequence."""
    words = Words(raw)
    h, n = words.hash, len(words)
    out = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : k + len(out)]
    out = mixed(out + np.uint64(width))
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            sets.append(np.unique(out[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * _BASE + x
                sets.append(mixed(np.asarray([whole + np.uint64(b - a)])))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
