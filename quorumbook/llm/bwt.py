"""Repeated strings of a bounded batch, by interval expansion on its Burrows-Wheeler transform.

Words are extended backwards breadth first: at step l every interval of suffixes
that start with a word of l symbols is split by the symbols before it.  The end of
a new interval is a place where neighbouring suffixes agree in l symbols only, so
common prefixes come out by increasing length; the expansion stops at the wanted
length, and what has no length by then agrees at least that far.
"""

from __future__ import annotations

import numpy as np

_BASE = 257
_FIRST = 7


def _ordered(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first ``length`` symbols at least; the order among equal ones is left open."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_FIRST, symbols.dtype)]).astype(np.int64)
    code = np.zeros(n, np.int64)
    for k in range(_FIRST):
        code = code * _BASE + padded[k:k + n]
    done = _FIRST
    while True:
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
        if done >= length or steps[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = steps + 1
        shift = min(done, length - done)
        code = rank * (n + 2)
        code[:max(0, n - shift)] += rank[shift:]
        done += shift


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body a mask of its starts (one per string of ``length`` bytes) whose string starts elsewhere too."""
    sizes = np.array([len(b) for b in bodies])
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0  # a boundary, lower than every byte
    order = _ordered(symbols, length)
    n = len(order)
    before = symbols[order - 1]  # the transform; the symbol before the first is the last boundary
    by_symbol = np.argsort(before, kind="stable")
    target = np.empty(n, np.int32)
    target[by_symbol] = np.arange(n, dtype=np.int32)
    last = np.full(n, -1, np.int32)  # the nearest place above and below with the same symbol
    following = np.full(n, n, np.int32)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]

    unknown = np.ones(n + 1, bool)
    unknown[[0, n]] = False
    low, high = np.array([0]), np.array([n - 1])
    for step in range(length):
        width = high - low + 1
        starts = np.cumsum(width) - width
        at = np.arange(width.sum()) + np.repeat(low - starts, width)
        if step:
            keep = before[at] > 0  # a word does not reach across a boundary
            first = at[keep & (last[at] < np.repeat(low, width))]
            final = at[keep & (following[at] > np.repeat(high, width))]
        else:
            first, final = at[last[at] < 0], at[following[at] == n]
        low, high = np.sort(target[first]).astype(np.int64), np.sort(target[final]).astype(np.int64)
        new = unknown[high + 1]
        low, high = low[new], high[new]
        unknown[high + 1] = False  # neighbours here agree in exactly ``step`` symbols
        if not len(low):
            break
    repeated = np.zeros(n, bool)
    agree = np.flatnonzero(unknown[1:n]) + 1
    repeated[order[agree]] = True
    repeated[order[agree - 1]] = True
    begins = ends - sizes
    return [repeated[b:b + max(0, size - length + 1)] for b, size in zip(begins, sizes)]
