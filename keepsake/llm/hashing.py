"""64-bit hashes of all words and word sequences of a text at once."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD1342543DE82EF95
_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= 2 * _CHUNK:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The hash of each slice ``values[start:end]``, the same wherever it stands."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each slice."""
    return spans_hash(values, starts, ends), spans_hash(mixed(values ^ np.uint64(_BASE2)), starts, ends, _BASE2)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each run of bytes other than ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.r_[True, _SPACE[raw], True].view(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if len(raw) <= _CHUNK:
        return starts, ends, spans_hash(_LETTERS[raw], starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    made, k = [], 0
    while k < len(starts):  # long texts in parts, cut between words
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _CHUNK, "right")))
        part = raw[starts[k]:ends[stop - 1]]
        made.append(spans_hash(_LETTERS[part], starts[k:stop] - starts[k], ends[k:stop] - starts[k]))
        k = stop
    return starts, ends, np.concatenate(made) if made else np.zeros(0, dtype=np.uint64)
