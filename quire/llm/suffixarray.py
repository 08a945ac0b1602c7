"""Suffix arrays by linear grouping.

First every suffix is put into the group of its Lyndon prefix: groups start as equal first symbols and
are taken in descending order; every member of the group points to the previous suffix in a smaller
group, and suffixes that k members point to move to a new group above their old one (more members,
higher group). Then the order is emitted: the suffix just found smallest places the suffixes before it,
along their previous-smaller pointers, at the next free place of their groups. No names are assigned
and nothing recurs.
"""

from __future__ import annotations

import numpy as np

from quire.llm.shipping import ship


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in ascending order. Every symbol is above 0 but the last, which
    is 0 and closes the text."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    start = np.searchsorted(ranked, symbols, "left")
    at = order.tolist()                       # suffixes, group by group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()                    # where a suffix stands in ``at``
    group = start.tolist()                    # first place of a suffix's group
    size = np.bincount(start, minlength=n).tolist()
    before = [-1] * n                         # previous suffix in a smaller group
    high = n - 1
    while high > 0:
        low = group[at[high]]
        if low == high:  # one member: at most one suffix moves
            s = at[high]
            high -= 1
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = group[p]
                if size[g] > 1:
                    size[g] -= 1
                    end = g + size[g]
                    i, other = place[p], at[end]
                    at[end], at[i] = p, other
                    place[p], place[other] = end, i
                    group[p], size[end] = end, 1
            continue
        members = sorted(at[low:high + 1])
        high = low - 1
        reached: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in reached.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved = by_count[k]
            olds = []
            for p in moved:  # to the end of the old group
                g = group[p]
                olds.append(g)
                size[g] -= 1
                end = g + size[g]
                i, other = place[p], at[end]
                at[end], at[i] = p, other
                place[p], place[other] = end, i
            fresh: dict[int, int] = {}
            for p, g in zip(moved, olds):
                new = g + size[g] if g not in fresh else fresh[g]
                fresh[g] = new
                group[p] = new
            counts: dict[int, int] = {}
            for g in olds:
                counts[g] = counts.get(g, 0) + 1
            for g, c in counts.items():
                size[fresh[g]] = c
    free = list(range(n))                     # next free place of the group that starts here
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return np.array(out, np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, up to ``most``."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for j in range(most):
        a, b = order[live] + j, order[live - 1] + j
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[symbols[a] == symbols[b]]
        if not len(live):
            break
        out[live] += 1
    return out


ship(__name__)
