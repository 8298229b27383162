"""Hashes of words, for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P, _P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in ASCII lower case, and where each text's words begin and end."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower touches A-Z only
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[data]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.full(len(data) + 1, _P, np.uint64)
    back = np.full(len(data) + 1, _P_INVERSE, np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.concatenate([[U(0)], np.cumsum((data.astype(np.uint64) + U(1)) * power[:-1])])
    word = mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))
    upto = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
    return word, np.concatenate([[0], upto[:-1]]).astype(np.int64), upto
