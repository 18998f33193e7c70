"""Word shingles of whole texts as sets of 64-bit hashes.

Words are runs of letters and digits in lower case. A text of fewer words than a shingle takes has one shingle, all its
words; a text without words has one, its characters. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import scan

CHUNK = 500_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base of the running sums and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        _powers.clear()
        for base in (_BASE, _BACK):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads its input over all bits."""
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Spans:
    """Hashes of any spans of an array of code points, from running sums."""

    def __init__(self, points: np.ndarray):
        powers, self._back = power_tables(len(points) + 1)
        self._sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._back[starts])


def _span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(points).hashes(starts, ends)


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word of one text, worked on in parts cut at white space."""
    out, begin = [], 0
    while begin < len(text):
        end = min(begin + CHUNK, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        points = scan.code_points(text[begin:end])
        edges = np.diff((scan.class_table()[points] <= scan.NUMBER).view(np.int8), prepend=0, append=0)
        out.append(_span_hashes(points, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)))
        begin = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total *= np.uint64(_STEP)
        total += words[k : len(words) - size + 1 + k]
    return mixed(total, size)


def _own(words: np.ndarray, text: str, size: int) -> np.ndarray:
    if len(words) >= size:
        return np.unique(_rolled(words, size))
    if len(words):
        return _rolled(words, len(words))
    points = scan.code_points(text)
    return _span_hashes(points, np.array([0]), np.array([len(points)])) ^ np.uint64(_STEP)


def sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    begin = 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end] or "") <= CHUNK):
            total += len(texts[end] or "") + 1
            end += 1
        some = [(t or "").lower() for t in texts[begin:end]]
        if len(some) == 1 and total > CHUNK:
            yield _own(word_hashes(some[0]), some[0], size)
        else:
            joined = "\n".join(some)
            points = scan.code_points(joined)
            edges = np.diff((scan.class_table()[points] <= scan.NUMBER).view(np.int8), prepend=0, append=0)
            starts = np.flatnonzero(edges == 1)
            words = _span_hashes(points, starts, np.flatnonzero(edges == -1))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(s) + 1 for s in some])).tolist()
            every = _rolled(words, size) if len(words) >= size else np.empty(0, np.uint64)
            for text, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                yield np.unique(every[a : b - size + 1]) if b - a >= size else _own(words[a:b], text, size)
        begin = end
