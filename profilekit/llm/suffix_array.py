"""Linear suffix sorting by grouping.

Suffixes are grouped by their Lyndon prefixes. Phase one starts with groups by first symbol and takes the groups in
descending order: each suffix of the group points to the nearest suffix before it in a smaller group; the
suffixes pointed at move, by how many point at them, to new groups just above their own. Phase two
emits the order: groups are blocks of the suffix array, and the suffixes that follow one another along the pointers are
placed at the next free place of their blocks. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of integers; a shorter suffix comes before those it is a prefix of."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    values, first = np.unique(np.asarray(symbols), return_inverse=True)
    # A smallest symbol of its own ends the sequence.
    group = (first + 1).tolist() + [0]
    total = n + 1
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(len(values) + 1)).tolist()
    placed_by_symbol = order.tolist()
    members: list[list[int]] = [[n]] + [placed_by_symbol[bounds[g]:bounds[g + 1]] for g in range(len(values))]
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members))) + [-1]
    done = [False] * len(members)
    pointer = [-1] * total

    current = len(members) - 1
    while current >= 0:
        done[current] = True
        pointed: dict[int, int] = {}
        own = members[current]
        if len(own) != size[current]:
            own = [s for s in own if group[s] == current]
        own.sort()
        for s in own:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[current] = own
        if pointed:
            # Most pointers first: v u^k is larger than v u^(k-1).
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                if size[group[p]] > 1:
                    by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                split: dict[int, list[int]] = {}
                for p in by_count[k]:
                    split.setdefault(group[p], []).append(p)
                for g, moved in split.items():
                    if len(moved) == size[g]:
                        continue  # the whole group moves: it stays what it is
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[g] -= len(moved)
                    done.append(False)
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    below[up] = new
                    for p in moved:
                        group[p] = new
        current = below[current]

    # Phase two: the free place of every group, groups in ascending order.
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    result = [-1] * total
    result[0] = n
    placed = [False] * total
    placed[n] = True
    for i in range(total):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = pointer[s]
    return np.array(result[1:], np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place but the first, how many symbols (``limit`` at most) its suffix shares with the one before."""
    symbols = np.asarray(symbols)
    n, shared = len(symbols), np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.ones(len(shared), bool)
    for k in range(limit):
        a, b = order[:-1] + k, order[1:] + k
        alive &= (a < n) & (b < n)
        same = np.zeros(len(shared), bool)
        same[alive] = symbols[a[alive]] == symbols[b[alive]]
        alive &= same
        shared += alive
    return shared
