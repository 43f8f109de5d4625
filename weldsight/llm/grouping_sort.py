"""Suffix array of an integer sequence by grouping suffixes with equal Lyndon prefixes."""

from __future__ import annotations

from array import array
from collections.abc import Sequence


def _filled(n: int, value: int) -> array:
    return array("i", [value]) * n


def suffix_array(seq: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``seq`` in ascending order; a suffix comes after its own prefixes.

    First, suffixes are grouped by their first symbol, and groups are taken from the largest to the smallest: each
    suffix of the group points to the nearest smaller suffix before it, whose Lyndon prefix the group extends; the
    suffixes pointed to leave their group for new ones right behind it, by how many pointers reach them. Then groups
    hold suffixes of equal Lyndon prefixes, and one pass over the growing array puts the suffix before each entry, and
    what its pointers reach, at the next free place of its group. No symbol is renamed and nothing recurses.
    """
    n = len(seq) + 1  # with an end that is smaller than any symbol
    order = sorted(range(n - 1), key=seq.__getitem__)
    at = array("i", [n - 1])
    at.extend(order)
    del order
    place, group = _filled(n, 0), _filled(n, 0)
    start, before = 0, None
    for k, i in enumerate(at):
        if k and (k == 1 or seq[i] != before):
            start = k
        before = seq[i] if k else None
        place[i], group[i] = k, start
    size = _filled(n + 1, 0)
    for g in group:
        size[g] += 1

    smaller = _filled(n, -1)  # the pointers
    skip = _filled(n, -1)  # shortcuts over suffixes of larger groups
    high = n - 1
    while high >= 0:
        g = group[at[high]]
        members = sorted(at[g : g + size[g]])
        reached: dict[int, int] = {}
        for i in members:
            path, j = [], i - 1
            while j >= 0 and group[j] > g:
                path.append(j)
                j = skip[j]
            for p in path:
                skip[p] = j
            if j >= 0 and group[j] == g:
                j = smaller[j]
            smaller[i] = skip[i] = j
            if j >= 0:
                reached[j] = reached.get(j, 0) + 1
        by_group: dict[int, list[tuple[int, int]]] = {}
        for j, times in reached.items():
            by_group.setdefault(group[j], []).append((times, j))
        for old, moved in by_group.items():
            moved.sort()
            if moved[0][0] == moved[-1][0] and len(moved) == size[old]:
                continue  # the whole group moves behind itself
            end = old + size[old]
            for k, (_, j) in enumerate(moved):  # to the end of the old group's range, in the order of the new groups
                to = end - len(moved) + k
                other = at[to]
                at[place[j]], place[other] = other, place[j]
                at[to], place[j] = j, to
            size[old] -= len(moved)
            new, times_before = -1, 0
            for k, (times, j) in enumerate(moved):
                if times != times_before:
                    new, times_before = end - len(moved) + k, times
                    size[new] = 0
                group[j] = new
                size[new] += 1
        high = g - 1

    free = array("i", range(n + 1))  # the next free place of a group
    placed = bytearray(n)
    out = _filled(n, -1)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out[1:].tolist()


def common_prefixes(seq: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the prefix that each suffix of the array shares with the one before it; 0 for the first."""
    n = len(seq)
    rank = _filled(n, 0)
    for k, i in enumerate(order):
        rank[i] = k
    out, h = _filled(n, 0), 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out.tolist()
