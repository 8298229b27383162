"""Simple-8b: unsigned integers packed into 64-bit words, whole arrays at a time.

The upper four bits of a word are its selector, which says how many integers of how many bits fill the
other 60. Integers of more than 60 bits escape: a word of selector 0 holds their upper 32 bits and the word
of selector 1 after it the lower ones, so that a word's meaning never depends on where reading began.
Every count from 1 up can be made of the selectors' counts, so no word is padded. Blocks of a fixed number of
integers start at words of their own, and their offsets let any block be decoded alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Integers a word for selectors 2 to 15; each gets 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
COUNT = np.array([0, 1, *COUNTS], np.int64)
WIDTH = np.array([0, 32, *(60 // c for c in COUNTS)], np.uint64)
MASK = (U(1) << WIDTH) - U(1)
PAYLOAD = U((1 << 60) - 1)
HALF = U((1 << 32) - 1)
ESCAPE_HIGH, ESCAPE_LOW = 0, 1


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place the selector of the word that would begin there: the one of most integers that fit, within the block."""
    n = len(values)
    place = np.arange(n)
    left = np.minimum(block - place % block, n - place)
    out = np.full(n, ESCAPE_LOW, np.uint8)
    for selector in range(15, 1, -1):
        count, width = int(COUNT[selector]), WIDTH[selector]
        small = values <= MASK[selector] if width < U(60) else values <= PAYLOAD
        if not small.any():
            break
        if count > n:
            continue
        wide = np.concatenate([[0], np.cumsum(~small)])
        fits = wide[count:] == wide[: n - count + 1]
        fits &= left[: n - count + 1] >= count
        out[: n - count + 1][fits] = selector
    return out


def encode(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the values' words, and the first word of each block of so many values (the last offset is the number of words)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    selector = _selectors(values, block)
    step = COUNT[selector]
    heads, at = np.zeros(n, bool), np.arange(0, n, block)
    end = np.minimum(at + block, n)
    while len(at):  # all blocks in step
        heads[at] = True
        at = at + step[at]
        on = at < end
        at, end = at[on], end[on]
    start = np.flatnonzero(heads)
    kind = selector[start]
    size = np.where(kind == ESCAPE_LOW, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(kind).tolist():
        those = kind == k
        head, to = start[those], place[those]
        if k == ESCAPE_LOW:
            words[to] = values[head] >> U(32)
            words[to + 1] = values[head] & HALF | U(ESCAPE_LOW << 60)
            continue
        packed = np.full(len(head), k << 60, np.uint64)
        for j in range(int(COUNT[k])):
            packed |= values[head + j] << U(j * int(WIDTH[k]))
        words[to] = packed
    first = np.searchsorted(start, np.arange(0, n, block))
    return words, np.concatenate([place[first], [len(words)]]).astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of words that begin and end where blocks do."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> U(60)).astype(np.int64)
    count = COUNT[kind]
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(words)), count)
    within = (np.arange(len(of)) - first[of]).astype(np.uint64)
    own = kind[of]
    out = (words[of] >> (within * WIDTH[own])) & MASK[own]
    low = np.flatnonzero(kind == ESCAPE_LOW)
    out[first[low]] |= (words[low - 1] & HALF) << U(32)
    return out
