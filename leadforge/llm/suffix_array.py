"""Suffix array of a set of strings by linear grouping.

Suffixes start in groups by their first symbol. Groups are processed from the
highest to the lowest: every member points to the nearest suffix before it in
its string whose group is not processed yet (its previous smaller suffix), and
the suffixes pointed to move to new groups just above their own, those with more
pointers higher. At the end the groups are ordered by their suffixes' longest
Lyndon prefix. One more scan fills the suffix array: the suffixes whose Lyndon
prefix ends where the current suffix begins take the next place of their groups;
the scan starts at the ends of the strings. No renaming, no recursion.

The first groups come from one whole-array sort. String ends are no symbols:
they are in no group and no pointer passes them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

END = -1  # behind every string


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Order of the suffixes of one string of symbols of 0 or more."""
    return joint_suffix_array([*symbols, END])


def joint_suffix_array(symbols: Sequence[int]) -> list[int]:
    """Order of the non-empty suffixes of strings that each end with ``END`` (other symbols are 0 or more).

    A suffix that is the beginning of another one comes before it; of equal ones, the one of the earlier string.
    """
    symbols = np.asarray(symbols, dtype=np.int64)
    n = len(symbols)
    ends = np.flatnonzero(symbols == END)
    if len(ends) == n:
        return []
    by_symbol = np.argsort(symbols, kind="stable")[len(ends):]
    ordered = symbols[by_symbol]
    borders = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    first = np.full(n, -1, dtype=np.int64)
    first[by_symbol] = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    group, flat, borders = first.tolist(), by_symbol.tolist(), borders.tolist()
    members = [flat[lo:hi] for lo, hi in zip(borders, borders[1:])]  # by group number
    below = list(range(-1, len(members) - 1))            # the next lower group
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    length = (first >= 0).astype(np.int64).tolist()      # of the prefix a suffix is grouped by
    previous = [-1] * n                 # previous smaller suffix
    steps = np.arange(-1, n)
    steps[ends + 1] = -1
    left = steps.tolist()               # left[i + 1]: i if unprocessed, else a step towards the nearest unprocessed one
    order = []                          # final groups, from the highest

    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            order.append(own)
            size = length[own[0]]
            for i in own:
                left[i + 1] = left[i]
            pointers: dict[int, int] = {}
            for i in own:
                j = left[i]
                if j < 0:
                    continue
                if left[j + 1] != j:
                    path = [i]
                    while j >= 0 and left[j + 1] != j:
                        path.append(j + 1)
                        j = left[j + 1]
                    for k in path:
                        left[k] = j
                    left[i + 1] = j
                    if j < 0:
                        continue
                previous[i] = j
                pointers[j] = pointers.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, count in pointers.items():
                key = (count, group[j])
                if key in moves:
                    moves[key].append(j)
                else:
                    moves[key] = [j]
            for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                count, old = key
                new, moved = len(members), moves[key]
                members.append(moved)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                grown = length[moved[0]] + count * size
                for j in moved:
                    group[j] = new
                    length[j] = grown
        g = below[g]

    # places of the groups, then the order inside them
    place = [0] * len(members)
    start = 0
    for own in reversed(order):
        place[group[own[0]]] = start
        start += len(own)
    result = [0] * start
    for scan in (ends.tolist(), result):
        for end in scan:
            j = end - 1
            while j >= 0 and j + length[j] == end:
                g = group[j]
                at = place[g]
                result[at] = j
                place[g] = at + 1
                j = previous[j]
    return result
