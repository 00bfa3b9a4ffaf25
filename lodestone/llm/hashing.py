"""Hashes of words and of character n-grams over whole arrays of text, in numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C13
#: One random 64-bit number for each byte value.
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_ODD, pow(_ODD, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each span, from prefix sums of a polynomial."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def separators(also: bytes = b"") -> np.ndarray:
    """Table over byte values: ASCII white space, and the given bytes."""
    table = np.zeros(256, bool)
    table[list(b" \t\n\x0b\x0c\r" + also)] = True
    return table


WHITE = separators()
NON_LETTERS = separators(bytes(b for b in range(128) if not chr(b).isalpha()))


def words(data: np.ndarray, table: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between separators."""
    edge = np.diff(np.concatenate([[True], table[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about most bytes: (first, last + 1, bytes joined by newlines, offset of each text)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to]) + 1
            to += 1
        lengths = np.array([len(t) + 1 for t in texts[at:to]])
        yield at, to, np.frombuffer(b"\n".join(texts[at:to]) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        at = to
