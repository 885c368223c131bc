"""Interval expansion on a Burrows-Wheeler transform, for one bounded block of text."""

from __future__ import annotations

import numpy as np

#: Symbols that fit one sort key: nine bits each (a byte plus one; zero ends a piece).
_PACKED = 7


def rotations(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all rotations, ordered by their first ``depth`` symbols or more (prefix doubling)."""
    n = len(symbols)
    rank = np.zeros(n, dtype=np.int64)
    for k in range(_PACKED):
        rank = (rank << 9) | np.roll(symbols, -k)
    known = _PACKED
    order = np.argsort(rank)
    while True:
        ordered = rank[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = new
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        rank = rank * n + np.roll(rank, -known)
        known *= 2
        order = np.argsort(rank)


def equal_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order, and for each the number of its class: equal classes share their first ``length`` symbols.

    Common prefixes of neighbouring rotations are derived by increasing value: an interval whose rotations share
    ``value`` symbols begins at a boundary; extending it backward by each symbol in it leads to the boundary of the
    interval that shares one symbol more. Every boundary is set once, by the smallest value that reaches it, and the
    expansion stops at ``length``: what has no boundary by then shares that much or more.
    """
    n = len(symbols)
    order = rotations(symbols, length + 1)
    last = symbols[order - 1]  # the transform; position -1 wraps round
    by_symbol = np.argsort(last, kind="stable")
    backward = np.empty(n, dtype=np.int64)
    backward[by_symbol] = np.arange(n)
    same = np.full(n, -1, dtype=np.int64)  # the row before that has the same symbol
    follows = last[by_symbol[1:]] == last[by_symbol[:-1]]
    same[by_symbol[1:][follows]] = by_symbol[:-1][follows]

    bounded = np.zeros(n, dtype=bool)
    starts = np.zeros(1, dtype=np.int64)
    ends = np.full(1, n, dtype=np.int64)
    for _ in range(length):
        sizes = ends - starts
        rows = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        first = same[rows] < np.repeat(starts, sizes)
        reached = backward[rows[first]]
        starts = np.sort(reached[~bounded[reached]])
        if not len(starts):
            break
        bounded[starts] = True
        edges = np.append(np.flatnonzero(bounded), n)
        ends = edges[np.searchsorted(edges, starts, side="right")]
    return order, np.cumsum(bounded)


def repeated_starts(
    pieces: list[bytes], weights: np.ndarray, length: int
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of ``length`` bytes in the pieces start more than once, a piece counting ``weight`` times.

    Gives per piece the starts that do; then, per different string, the piece and the start of one of its places
    and whether it is repeated here.
    """
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(pieces), dtype=np.int64)
    whole = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    inside = np.ones(len(symbols), dtype=bool)
    inside[begins + sizes] = False
    symbols[inside] = whole[inside].astype(np.int64) + 1
    of = np.repeat(np.arange(len(pieces)), sizes + 1)
    at = np.arange(len(symbols)) - begins[of]
    usable = at + length <= sizes[of]

    order, classes = equal_prefixes(symbols, length)
    order_usable = usable[order]
    order, classes = order[order_usable], classes[order_usable]
    totals = np.bincount(classes, weights=weights[of[order]].astype(float), minlength=1)
    twice = totals[classes] >= 2
    marked = np.sort(order[twice])
    cuts = np.searchsorted(marked, np.append(begins, len(symbols)))
    found = [marked[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begins)]
    _, one = np.unique(classes, return_index=True)
    return found, of[order[one]], at[order[one]], twice[one]


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive sorted integers."""
    if not len(values):
        return []
    breaks = np.flatnonzero(np.diff(values) != 1)
    return list(zip(values[np.append(0, breaks + 1)].tolist(), values[np.append(breaks, len(values) - 1)].tolist()))
