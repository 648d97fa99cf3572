"""Suffix sorting by grouping: suffixes are gathered by Lyndon prefix, then each group is emitted in order.

Groups are processed from the highest to the lowest. Every suffix of a group points to the previous suffix of a smaller
group; suffixes that are pointed to are split off into larger groups, by how many pointers they get. When all groups are
done, a group's suffixes share their Lyndon prefix, and one pass over the growing suffix array places every suffix by
following the same pointers. No ranks are renamed and nothing is sorted recursively; the work is linear.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; a suffix that is a prefix of another one comes first."""
    n = len(symbols) + 1
    text = np.append(symbols.astype(np.int64) - (symbols.min() if n > 1 else 0) + 1, 0)
    array = np.argsort(text, kind="stable")
    first = np.ones(n, bool)
    first[1:] = text[array[1:]] != text[array[:-1]]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    group_of = np.empty(n, np.int64)
    group_of[array] = np.repeat(starts, sizes)
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    group, previous = _groups(array.tolist(), place.tolist(), group_of.tolist(), dict(zip(starts.tolist(), sizes.tolist())))
    return np.array(_emit(group, previous)[1:], np.int64)


def _groups(array: list[int], place: list[int], group: list[int], size: dict[int, int]) -> tuple[list[int], list[int]]:
    """Final group (its first place) of each suffix, and its pointer to the previous suffix of a smaller group."""
    n = len(array)
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[array[end - 1]]
        pointed: dict[int, int] = {}
        members = array[start:end] if end - start == 1 else sorted(array[start:end])
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            p = next(iter(pointed))
            moves = {1: {group[p]: [p]}}
        else:
            moves = {}
            for p, times in pointed.items():
                moves.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            for old, some in moves[times].items():
                left = size[old] - len(some)
                if not left:
                    continue  # the whole rest of the group is pointed to alike
                size[old] = left
                new = old + left
                size[new] = len(some)
                at = new
                # members move to the group's end; whoever stood there takes their place
                inside = {p for p in some if place[p] >= new}
                for p in some:
                    group[p] = new
                    if p in inside:
                        continue
                    while array[at] in inside:
                        at += 1
                    other, hole = array[at], place[p]
                    array[hole], place[other] = other, hole
                    array[at], place[p] = p, at
                    at += 1
        end = start
    return group, previous


def _emit(group: list[int], previous: list[int]) -> list[int]:
    """The suffix array: each placed suffix places the chain of pointers of the suffix before it."""
    n = len(group)
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free = list(range(n))
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            slot = free[g]
            out[slot] = j
            free[g] = slot + 1
            placed[j] = 1
            j = previous[j]
    return out
